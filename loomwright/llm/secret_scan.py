"""Secret scanning: candidate patterns, then a random forest against false positives.

Patterns find candidates; the forest judges each by its length, character
transitions and classes, how much of it dictionary words cover, the path it
stands in and the words beside it. It is fitted on labelled findings: a table
of (path, text, start, end, label) of the caller's, or the generated ones of
:func:`sample_findings`, bounded by ``SAMPLE`` and the same in every run.
"""

from __future__ import annotations

import json
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import small_batches

SAMPLE, TREES, DEPTH, LEAST_LEAF, SEED = 4000, 40, 9, 3, 11
THRESHOLD, NEAR_CHARS = 0.5, 40

# Public formats of credentials, first match wins. Runs have no
# upper bound and are possessive, so a candidate is whole and a scan linear.
KINDS = [
    ("aws_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("github_token", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    ("slack_token", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+"),
    ("google_key", r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}"),
    ("stripe_key", r"(?<![A-Za-z0-9])[rs]k_(?:live|test)_[A-Za-z0-9]{16,}+"),
    ("jwt", r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{32,}+)*+)"),
    ("assigned", r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)[a-zA-Z_]{0,12}[\"']?\s{0,2}[:=]\s{0,2}[\"']?(?P<v>[^\s\"',;<>]{6,}+)"),
    ("opaque", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"),
]
CANDIDATE = re.compile("|".join(f"(?P<{n}>{p})" for n, p in KINDS))
# Words beside a finding that speak for or against it.
FOR = frozenset("password passwd pwd secret token key apikey api credential auth bearer login private access".split())
AGAINST = frozenset("commit sha sha1 sha256 md5 hash checksum digest etag uuid guid id example sample placeholder dummy revision version integrity".split())
PATH_AGAINST = re.compile(r"test|example|sample|fixture|mock|doc|readme|lock", re.I)
PLACEHOLDER = re.compile(r"example|your|change|dummy|sample|placeholder|xxx|\*\*\*|test|<|\$\{|\{\{|(.)\1{5}|1234567|abcdef", re.I)
WORDS = re.compile(r"[A-Za-z]+[0-9]*")


@lru_cache(maxsize=1)
def dictionary(path: str) -> frozenset[str]:
    """Words of four letters and more that end a word in a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return frozenset(w for t in vocab if t.endswith("</w>") and len(w := t[:-4]) >= 4 and w.isascii() and w.isalpha())


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the candidates of a whole text."""
    out = []
    for m in CANDIDATE.finditer(text or ""):
        out.append((*(m.span("v") if m.lastgroup == "v" or m["assigned"] else m.span()), m.lastgroup if m.lastgroup != "v" else "assigned"))
    return out


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(path: str | None, text: str, start: int, end: int, kind: str, words: frozenset[str]) -> list[float]:
    value = text[start:end]
    n = max(1, len(value))
    counts = Counter(value)
    classes = [_class(c) for c in value]
    share = [classes.count(k) / n for k in range(4)]
    changes = sum(a != b for a, b in zip(classes, classes[1:])) / max(1, n - 1)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    low = value.lower()
    vowels = sum(1 for a, b in zip(low, low[1:]) if a.isalpha() and b.isalpha() and (a in "aeiou") != (b in "aeiou")) / max(1, n - 1)
    covered, at = 0, 0
    letters = re.sub(r"[^a-z]", " ", low)
    while at < len(letters):
        size = next((k for k in range(min(14, len(letters) - at), 3, -1) if letters[at : at + k] in words), 0)
        covered += size
        at += size or 1
    before = [w.lower() for w in WORDS.findall(text[max(0, start - NEAR_CHARS) : start])][-4:]
    after = [w.lower() for w in WORDS.findall(text[end : end + NEAR_CHARS])][:2]
    near = [p for w in before + after for p in (w, *re.split(r"[^a-z]+", w))]
    return [
        float(n), entropy, *share, changes, vowels, covered / n,
        float(all(c in string.hexdigits for c in value)), float(value.isdigit()), len(counts) / n,
        float(sum(w in FOR for w in near) > 0), float(sum(w in AGAINST for w in near) > 0),
        float(bool(re.search(r"[:=]\s*[\"']?$", text[max(0, start - 4) : start]))), float(bool(PLACEHOLDER.search(value))),
        float(bool(PATH_AGAINST.search(path or ""))), float(kind not in ("assigned", "opaque")), float(kind == "opaque"),
        float("/" in value or "-" in value or "_" in value),
    ]


def sample_findings(n: int = SAMPLE) -> list[tuple[str, str, int, int, bool]]:
    """Labelled findings made from public formats: keys and passwords in code
    and prose against hashes, ids, placeholders, names and numbers."""
    r = random.Random(SEED)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    prose = lambda: " ".join(pick(string.ascii_lowercase, r.randint(2, 9)) for _ in range(r.randint(0, 5)))
    names = ["get", "user", "config", "value", "handler", "database", "session", "request", "default", "manager", "service", "builder"]
    true = [
        lambda: ("", "AKIA" + pick(string.ascii_uppercase + "234567", 16)),
        lambda: ("", "AKIA" + pick(string.ascii_uppercase + string.digits, 16)),
        lambda: ("", "ghp_" + pick(alnum, 36)),
        lambda: (r.choice(["token = \"", "secret = \"", "api_key: ", "token="]), pick(hexes, r.choice([32, 40, 64]))),
        lambda: (r.choice(["password=", "password: ", "pwd = \"", "passwd="]), pick(hexes, r.randint(12, 24))),
        lambda: (r.choice(["password=", "secret: ", "auth_token = \""]), pick(alnum + "!@#%^&", r.randint(10, 32))),
        lambda: (r.choice(["Bearer token: ", "access_key = \""]), pick(alnum + "+/", 40)),
        lambda: ("", "sk_live_" + pick(alnum, 24)),
    ]
    false = [
        lambda: (r.choice(["commit ", "sha1: ", "revision ", "etag = \""]), pick(hexes, 40)),
        lambda: (r.choice(["md5 ", "checksum: ", "sha256 = ", "digest "]), pick(hexes, r.choice([32, 64]))),
        lambda: (r.choice(["id ", "uuid = \"", ""]), "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))),
        lambda: (r.choice(["password=", "token = \"", "api_key="]), r.choice(["your_api_key_here", "changeme123", "xxxxxxxxxxxx", "example-token", "<password>", "${PASSWORD}"])),
        lambda: ("", "AKIA" + pick(string.ascii_uppercase, 9) + "EXAMPLE"),
        lambda: (r.choice(["token = ", "auth: ", "password = "]), "_".join(r.sample(names, r.randint(2, 3)))),
        lambda: ("", "/".join(r.sample(names, 4)) + str(r.randint(1, 99))),
        lambda: ("", "-".join(r.sample(names, 4)) + str(r.randint(1, 9999))),
        lambda: (r.choice(["token=", "key "]), str(r.randint(10**6, 10**9))),
    ]
    out = []
    while len(out) < n:
        label = len(out) % 2 == 0
        lead, value = r.choice(true if label else false)()
        head = prose() + " " + lead
        text = head + value + ("\"" if lead.endswith("\"") else "") + " " + prose()
        path = r.choice(["src/main.py", "config/prod.yaml", "docs/readme.md", "tests/test_app.py", "src3", "web", ""])
        out.append((path, text, len(head), len(head) + len(value), label))
    return out


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1: leaf), cut, left child, right child, share."""

    trees: tuple[tuple[np.ndarray, ...], ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (go := feature[at] >= 0).any():
                f = feature[at[go]]
                at[go] = np.where(x[go, f] <= cut[at[go]], left[at[go]], right[at[go]])
            total += share[at]
        return total / len(self.trees)


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    feature, cut, left, right, share = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(feature)
        feature.append(-1)
        cut.append(0.0)
        left.append(0)
        right.append(0)
        share.append(float(y[rows].mean()))
        if depth == DEPTH or len(rows) < 2 * LEAST_LEAF or share[me] in (0.0, 1.0):
            return me
        best = (1e-9, -1, 0.0)
        base = share[me] * (1 - share[me])
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, hits = x[order, f], np.cumsum(y[order])
            k = np.arange(1, len(v))
            ok = (v[1:] > v[:-1]) & (k >= LEAST_LEAF) & (len(v) - k >= LEAST_LEAF)
            if ok.any():
                p, q = hits[:-1] / k, (hits[-1] - hits[:-1]) / (len(v) - k)
                gain = np.where(ok, base - (k * p * (1 - p) + (len(v) - k) * q * (1 - q)) / len(v), -1)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), int(f), float((v[i] + v[i + 1]) / 2))
        if best[1] >= 0:
            go = x[rows, best[1]] <= best[2]
            feature[me], cut[me] = best[1], best[2]
            left[me] = node(rows[go], depth + 1)
            right[me] = node(rows[~go], depth + 1)
        return me

    node(rng.integers(0, len(x), len(x)), 0)
    return tuple(np.array(a) for a in (feature, cut, left, right, share))


def fit_forest(findings: Iterable[tuple[str, str, int, int, bool]], words: frozenset[str]) -> Forest:
    rows, labels = [], []
    for path, text, start, end, label in findings:
        kind = next((k for s, e, k in candidates(text) if s <= start < e), "opaque")
        rows.append(features(path, text, start, end, kind, words))
        labels.append(float(label))
    x, y, rng = np.array(rows), np.array(labels), np.random.default_rng(SEED)
    return Forest(tuple(_grow(x, y, rng) for _ in range(TREES)))


def judge(forest: Forest, words: frozenset[str], paths: Sequence[str | None], texts: Sequence[str | None]) -> list[list[tuple]]:
    """Per text its candidates: (start, length, kind, value, score)."""
    found = [candidates(t) for t in texts]
    x = [features(p, t or "", s, e, k, words) for p, t, c in zip(paths, texts, found, strict=True) for s, e, k in c]
    scores = iter(forest.predict(np.array(x)).tolist() if x else ())
    return [[(s, e - s, k, (t or "")[s:e], next(scores)) for s, e, k in c] for t, c in zip(texts, found, strict=True)]


def scan(docs: DataFrame, words_path: str, forest: Forest | None = None, text_col: str = "text", path: Column | None = None, out: str = "findings") -> DataFrame:
    """``docs`` with an array of findings, each with its place in code points,
    kind, value, score and whether it is taken for a secret. Null and empty
    texts have none; ``path`` may be null; a column named ``out`` is replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(forest or fit_forest(sample_findings(), dictionary(words_path)))
    kind = "array<struct<start:long,length:int,kind:string,value:string,score:double,secret:boolean>>"
    fields = pa.struct([("start", pa.int64()), ("length", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("score", pa.float64()), ("secret", pa.bool_())])

    @F.arrow_udf(kind)
    def findings(paths: pa.Array, texts: pa.Array) -> pa.Array:
        rows = judge(shared.value, dictionary(words_path), paths.to_pylist(), texts.to_pylist())
        names = ("start", "length", "kind", "value", "score")
        return pa.array([[dict(zip(names, f)) | {"secret": f[4] >= THRESHOLD} for f in r] for r in rows], pa.list_(fields))

    return docs.withColumn(out, findings(F.lit(None).cast("string") if path is None else path.cast("string"), F.col(f"`{text_col}`")))
