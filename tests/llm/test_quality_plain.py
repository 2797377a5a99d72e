"""The quality query against a plain discriminant over plainly counted statistics."""

import math
import re
import zlib

import numpy as np

from voxloom.llm import catalogue, quality


def plain_statistics(text):
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\t-\r ]+", raw) if w]
    n = len(raw)
    share = lambda count: math.sqrt(count / (n + 128))
    among = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    symbol = b"#$%&*+<=>[\\]^`{}~"
    same = sum(raw[k] == raw[k - 1] and raw[k : k + 1] in [bytes([c]) for c in symbol + b"!.,;:?"] for k in range(1, n))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        math.log(1 + n), math.log(1 + len(words)), math.log(1 + (n - among(b" \t\n\r\v\f")) / (len(words) + 1)),
        share(sum(65 <= c <= 90 for c in raw)), share(sum(48 <= c <= 57 for c in raw)), share(among(b".,;:?")), share(among(b"'\"()-_/@")),
        share(among(symbol)), share(among(b"!")), share(among(b"|")), share(sum(c >= 128 for c in raw)), share(raw.count(b"\n")), share(same),
        math.sqrt(again / (len(words) + 20)),
    ]


def test_scores_of_the_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["quality"] is not None]
    x = {k: np.array(plain_statistics(t)) for k, t in docs.items()}
    kept = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 3 != 1 and k in x]
    groups = [np.array([x[k] for k, y in kept if y == c]) for c in (0, 1)]
    total = sum(map(len, groups))
    pooled = sum(len(g) * np.cov(g.T, bias=True) for g in groups) / total
    scale = np.diag(1 / np.sqrt(np.maximum(np.diag(pooled), 1e-9)))
    dims = len(quality.STATISTICS)

    def density(v, g):
        own = scale @ np.cov(g.T, bias=True) @ scale
        own = 0.9 * own + 0.1 * max(np.trace(own) / dims, 1e-3) * np.eye(dims)
        d = scale @ (v - g.mean(0))
        return math.log(len(g) / total) - 0.5 * (np.linalg.slogdet(own)[1] + d @ np.linalg.solve(own, d))

    for row in catalogue.op1_quality(spark, sf_dir).collect():
        v = x[row["doc_id"]]
        logit = (density(v, groups[1]) - density(v, groups[0])) / dims
        wanted = 1 / (1 + math.exp(-min(30, max(-30, logit))))
        assert abs(row["score"] - wanted) < 1e-6 and row["predicted"] == (row["score"] >= 0.5)
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1)
