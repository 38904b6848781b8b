"""Resampling, sharded k-means and line duplicates against brute force and SQL; internal column names as extra columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from fleetpulse.llm import html_text, line_dedup, queries
from fleetpulse.llm.bpe import bpe_encode
from fleetpulse.llm.exact_dedup import drop_exact_copies
from fleetpulse.llm.hpy_lm import hpy_score
from fleetpulse.llm.html_text import extract_main_text, main_text
from fleetpulse.llm.jaccard_join import drop_near_copies
from fleetpulse.llm.language_id import LanguageProfiles
from fleetpulse.llm.line_dedup import dedup_lines
from fleetpulse.llm.quality_rules import judge_quality
from fleetpulse.llm.resample import crcs_of, importance_resample, spans_pattern
from fleetpulse.llm.secret_scan import SecretScanner, scan_secrets
from fleetpulse.llm.shard_tree import assign_shards
from fleetpulse.llm.sharded_lloyd import cluster_vectors
from fleetpulse.llm.source_mix import mix_sources

SMALL = "/root/testdata/sf0.001"


def grams(text, longest=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[k : k + n]) for k in range(len(words)) for n in range(1, longest + 1) if k + n <= len(words)]


def brute_resample(docs, target, percent=25, least=20):
    def counts(texts):
        out = collections.Counter()
        for t in texts:
            out.update(zlib.crc32(g.encode()) % 10000 for g in grams(t)[1])
        return out, float(sum(out.values()))

    (own, s), (other, t) = counts(x for _, x in docs), counts(target)
    rows = []
    for key, text in docs:
        words, found = grams(text)
        gains = [math.floor(1000 * math.log((other[b] + 1.0) * (s + 10000) / ((own[b] + 1.0) * (t + 10000)))) for b in (zlib.crc32(g.encode()) % 10000 for g in found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def listed(rows):
    return sorted(map(tuple, rows), key=repr)


def test_resample_agrees_with_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert listed(queries.op11_importance_resample(spark, SMALL).collect()) == listed(brute_resample(docs, target))


def test_resample_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n!"), (4, "Ünï code ÉA" * 30), (5, "a b " * 4000), (5, "a b " * 4000), (None, "one two three " * 9), (8, "one two three " * 9)]
    docs += [(k, "same text over and over " * 6) for k in range(20, 60)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, id int")
    target = spark.createDataFrame([("one two", 1), (None, 2)], "text string, text_ int")
    columns = ("id", "n_features", "weight", "score", "rank")
    for percent in (0, 25, 100):
        got = importance_resample(frame, target, percent=percent).select(*columns).collect()
        assert listed(got) == listed(brute_resample(docs, ["one two", None], percent))
    assert listed(importance_resample(frame, target.limit(0)).select(*columns).collect()) == listed(brute_resample(docs, []))
    assert importance_resample(frame.limit(0), target).count() == 0


def test_spans_of_longer_runs():
    for text in ("", "a", "a b", "A--b c1 d é", "x " * 50):
        words, crcs = crcs_of(text.encode(), spans_pattern(3), 3)
        assert words == len(grams(text)[0]) and sorted(crcs) == sorted(zlib.crc32(g.encode()) for g in grams(text, 3)[1])


def brute_lloyd(rows, clusters, rounds, dims):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centers = [list(q) for _, q in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(centers)) for _, q in kept]

    for _ in range(rounds):
        best = assign()
        for k in range(len(centers)):
            mine = [q for (_, q), (_, c) in zip(kept, best) if c == k]
            if mine:
                centers[k] = [sum(col) // len(mine) for col in zip(*mine)]
    best = assign()
    of = collections.Counter()
    for d, k in best:
        of[k] += d
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return [(i, k, d, of[k], sum(of.values()), text[k]) for (i, _), (d, k) in zip(kept, best)]


@pytest.mark.parametrize("width, chunk_rows, per_shard", [(16, 4096, 64), (3, 7, 2), (64, 1, 1)])
def test_lloyd_agrees_with_brute_force(spark, width, chunk_rows, per_shard):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(60)]
    rows += [(100, [1.0] * 8), (100, [1.0] * 8), (None, [1.0] * 8), (101, None), (102, []), (103, [1.0] * 7), (104, [None] + [1.0] * 7), (105, [math.nan] + [1.0] * 7), (106, [math.inf] * 8), (107, [0.0] * 8)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, chunk string").repartition(3)
    got = cluster_vectors(frame, clusters=5, rounds=4, dims=8, width=width, chunk_rows=chunk_rows, per_shard=per_shard).collect()
    assert listed(got) == listed(brute_lloyd(rows, 5, 4, 8))


def test_lloyd_of_few_and_of_large_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [5.0, 5.0])], "vec_id long, embedding array<double>")
    assert listed(cluster_vectors(frame, dims=2).collect()) == listed(brute_lloyd([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [5.0, 5.0])], 8, 10, 2))
    assert cluster_vectors(frame.limit(0), dims=2).count() == 0 and cluster_vectors(frame, dims=3).count() == 0
    with pytest.raises(Exception, match="scaled component"):
        cluster_vectors(spark.createDataFrame([(1, [1e30, 2.0])], frame.schema), dims=2)


def brute_lines(docs, least_chars=40, least_docs=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holds = collections.defaultdict(set)
    for d, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holds[key(line)].add(-1 if d is None else d)
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        own = -1 if d is None else d
        kept = [x for x in lines if len(holds.get(key(x), ())) < least_docs or max(holds[key(x)]) == own]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("slices", [256, 2])
def test_lines_agree_with_brute_force(spark, monkeypatch, slices):
    monkeypatch.setattr(line_dedup, "SLICES", slices)
    a, b = "The quick brown fox jumps over the lazy dog again", "Ünd noch eine lange Zeile, die oft vorkommt ÄÖÜ"
    docs = [(k, f"{a}\nown {k}\n \t{a.upper()}\r\n{b}") for k in range(6)]
    docs += [(6, b), (6, b + "\n" + b), (None, a), (None, "x\n" * 200 + a + "\n" + "y\n" * 70 + a), (7, None), (8, ""), (9, "\n"), (10, "word " * 60_000), (11, b.replace("ÄÖÜ", "äöü")), (12, a[:39])]
    docs += [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    frame = spark.createDataFrame([(*d, d[0], d[0], d[0]) for d in docs], "doc_id long, text string, spot long, n_lines long, __place long").repartition(5)
    done = dedup_lines(frame)
    assert set(done.columns) == {"doc_id", "spot", "__place", "n_lines", "n_dropped", "kept_text"}
    assert listed(done.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()) == listed(brute_lines(docs))
    assert dedup_lines(frame.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op12_sharded_lloyd", "op13_line_dedup"])
def test_queries_agree_with_sql(spark, name):
    for sf in (SMALL, "/root/testdata/sf0.01"):
        ok, note = compare(spark, duck(sf), queries.QUERIES[name], queries.SQL[name], sf)
        assert ok, note


def test_line_dedup_stays_in_the_jvm(spark, capsys):
    queries.op13_line_dedup(spark, SMALL).explain()
    assert not re.search(r"Python|Arrow|Pandas", capsys.readouterr().out)


INTERNAL = ["__place", "__text", "__html", "__key", "__junk", "__row", "__train", "__block", "__metadata", "place", "digest", "hash", "spot", "chunk", "key", "at"]


def test_internal_names_as_extra_columns(spark):
    rows = [(1, "one two three four five six seven", 1), (2, "one two three four five six seven", 1), (3, "something else that is here", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *[F.lit("x").alias(c) for c in INTERNAL])
    kept = {"doc_id", "lang", *INTERNAL}
    for drop in (drop_exact_copies, drop_near_copies):
        left = drop(frame)
        assert left.columns == frame.columns and left.count() == 2
    judged, _ = judge_quality(frame, spark.createDataFrame([(1, 0)], "doc_id long, quality int"))
    found = [
        judged, bpe_encode(frame, public_tokenizers.path(queries.VOCABULARY)), scan_secrets(frame), LanguageProfiles.fit(frame).predict(frame), dedup_lines(frame),
        extract_main_text(frame.withColumn("html", F.col("text"))), mix_sources(frame.withColumn("source", F.lit("s"))), assign_shards(frame),
        hpy_score(frame, F.lit(True)),
    ]
    for df in found:
        rows = df.collect()
        assert len(rows) == 3 and kept <= set(df.columns) and all(r["__place"] == r["at"] == "x" for r in rows)


def test_guesses_of_long_values_and_of_words_with_a_digit():
    scanner = SecretScanner()
    for text in ("password: " + "a" * 250, "password: " + "a" * 30_000, "pwd: " + "ab" * 9_000, "the secret is understanding", "the secret is understanding1", "the token is configuration2"):
        assert not scanner.guess(text)
    for text in ("pwd: x8Kq2!vP9zLw", "pwd: " + "".join(chr(33 + (k * k * 7 + k) % 90) for k in range(4000) if chr(33 + (k * k * 7 + k) % 90) not in "\"'`,;<>")):
        assert scanner.guess(text)


LONG_P = "<p>" + "a long paragraph of the article with many words in it " * 4 + "</p>"


def test_text_that_is_no_boilerplate_stays(monkeypatch):
    whole = " ".join(("a long paragraph of the article with many words in it " * 4).split())
    sections = f"<body><div><section>{LONG_P * 5}</section><section><p>short</p></section></div></body>"
    assert main_text(sections) == "\n".join([whole] * 5 + ["short"])
    marked = f"<article><section id='related-work'>{LONG_P}</section><h2 id='social-impact'>Impact</h2>{LONG_P}<div id='comments'><p>nice</p></div></article>"
    assert main_text(marked) == f"{whole}\nImpact\n{whole}"
    page = f"<body><form id='aspnetForm'><div>{LONG_P * 3}</div></form></body>"
    assert main_text(page) == "\n".join([whole] * 3)
    assert main_text(f"<body><div>{LONG_P * 3}</div><form><p>Your name</p></form></body>") == "\n".join([whole] * 3)
    comments = f"<main>{LONG_P * 2}<article class='comment'><p>I like it</p></article></main>"
    assert main_text(comments) == "\n".join([whole] * 2)
    links = "<div>" + "".join(f"<p><a href=x><b><i>link {k}</i></b></a></p>" for k in range(12)) + "</div>"
    plain = f"<body>{links}<div>{LONG_P * 4}</div>{links}</body>"
    assert main_text(plain) == "\n".join([whole] * 4)
    monkeypatch.setattr(html_text, "upper_cluster", lambda x: np.ones(len(x), bool))
    assert main_text(plain).count("link") == 24  # the clusters decide
