"""Operations of a large-scale training-data pipeline, each usable by itself."""
