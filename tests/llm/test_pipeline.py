"""The corpus pipeline as a whole against a brute-force form of its stages, and on awkward tables."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import decontam, line_dedup, quality
from tests.llm.test_operators import SF, awkward, brute_components, brute_quality, clashing, words


def brute_quality_stage(rows):
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", x.lower())).strip()
    holds, hosts = {}, {}
    for d, t, s in rows:
        hosts.setdefault(s, set()).add((d, t))
        for x in {norm(x) for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")}:
            holds.setdefault((s, x), set()).add((d, t))
    over = {k for k, v in holds.items() if len(v) > max(quality.MIN_DOCS, quality.MAX_SHARE * len(hosts[k[0]])) and len({t for _, t in v}) > quality.MIN_DOCS}
    out = []
    for d, t, s in rows:
        left = "\n".join(x for x in t.split("\n") if not ((s, norm(x)) in over and x.strip(" \t\r\x0b\x0c")))
        n, *_, failed = brute_quality(t)
        n_left = len(re.findall(r"[^\x20\x09-\x0D]+", left))
        if not failed and not (n_left < n and (n_left < quality.MIN_WORDS or n_left < quality.MIN_KEPT_SHARE * n)):
            out.append((d, left, s))
    return out


def brute_line_stage(rows):
    rows = sorted(rows)
    lines = [(d, p, x.strip(line_dedup.BLANKS)) for d, t, _ in rows for p, x in enumerate(t.split("\n"))]
    first = {}
    for d, p, x in lines:
        first.setdefault(x, (d, p))
    texts, near = [x for x in first if len(x) >= line_dedup.PER_EDIT], {}
    by_size = {}
    for x in texts:
        by_size.setdefault(len(x), []).append(x)
    for x in texts:
        for n in range(len(x) - 2, len(x) + 1):
            tau = line_dedup.allowed(n)
            for y in by_size.get(n, ()) if tau and len(x) - n <= tau else ():
                if x != y and line_dedup.within(x, y, tau):
                    near.setdefault(x, []).append(y)
                    near.setdefault(y, []).append(x)
    out = []
    for d, t, s in rows:
        kept = [x for p, x in enumerate(t.split("\n")) if not (y := x.strip(line_dedup.BLANKS)) or first[y] == (d, p) and not any(first[z] < first[y] for z in near.get(y, ()))]
        if len(kept) == len(t.split("\n")) or re.search(r"[^\x20\x09-\x0D]", "\n".join(kept)):
            out.append((d, "\n".join(kept), s))
    return out


def brute_near_stage(rows):
    def shingles(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
        return tuple(sorted({tuple(w[i : i + 5]) for i in range(len(w) - 4)})) if len(w) >= 5 else (tuple(w),)

    sets = {d: shingles(t) for d, t, _ in rows}
    comp = brute_components(set(sets.values()), lambda a, b: 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b)))
    least = {}
    for d in sorted(sets):
        least.setdefault(comp[sets[d]], d)
    return [r for r in rows if least[comp[sets[r[0]]]] == r[0]]


def brute_decontaminated(rows, items):
    tok = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    code = lambda w: np.array([xxhash.xxh64_intdigest(x) | 1 for x in w], np.uint64)
    out, items = [], [tok(t) for t in items]
    for r in rows:
        w = tok(r[1])
        hit = any(x and 3 * len(set(x) & set(w)) >= len(set(x)) and decontam.align(code(x), code(w)[None, :])[0][0] >= decontam.MIN_SCORE * 2 * len(x) for x in items)
        out += [] if hit else [r]
    return out


def test_pipeline_equals_brute_force(spark):
    rows = [(r.doc_id, r.text or "", r.source or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_decontaminated(brute_near_stage(brute_line_stage(brute_quality_stage(rows))), items)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((d, t) for d, t, _ in want)
    assert all(r.rate >= 0 for r in got) and 0 < len(got) < len(rows)


def test_pipeline_awkward(spark, tmp_path):
    """Nulls, repeats, very long texts, clashing columns and empty tables go through all stages."""
    rng = random.Random(1)
    rows = awkward() + [(500, words(rng, 30_000), None, "s0", None), (501, words(rng, 40), "en", None, 1)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, words(rng, 30)), (2, None), (None, "x")], "item_id long, text string")
    for name, tables in (("some", (docs, labels, bench)), ("none", (docs.limit(0), labels, bench)), ("bare", (docs, labels.limit(0), bench.limit(0)))):
        for t, df in zip(("documents", "labels", "benchmark"), tables):
            df.write.parquet(str(tmp_path / name / f"{t}.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        got = out.collect()
        assert (len(got) == 0) == (name == "none") and set(docs.columns) - {"rate", "n_tokens"} <= set(out.columns)
        kept = {r.doc_id for r in got}
        assert name == "none" or {500, 501} <= kept and all(r.fp == "own fp" for r in got)
        read = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for stage, f in corpus_pipeline.STAGES[:-1]:
            assert f(spark, read, str(tmp_path / name)).columns == docs.columns, stage
    assert docs.where(F.col("doc_id") == 500).count() == 1
