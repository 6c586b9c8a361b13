"""Every operator and stage on one hard table: nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns named like the operators' own; and on an empty one."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_edges import WORD, near, order, plain_edits, plain_spans, removed_words, rows_of, sentence

import corpus_pipeline
from fairlead.llm import decontaminate, exact_dedup, jaccard_join, line_dedup, mixing, pii, quality, substring_dedup, token_store, url_filter

#: Names that the operators use for columns of their own.
CLASHING = "doc row_key node other n tokens size src h range last most copies rank path a b class links component blocks block task shingles word lines w p f windows at digest starts begins ends kept n_words n_removed kept_sha256 marks runs minimiser k1 k2 address salt keep_id group_size text_sha256 part page first levels docs number fairlead_item_ids fairlead_log_weight log_weight key spans scores m_email s_ip row".split()


@pytest.fixture(scope="module")
def hard(spark):
    rng = np.random.default_rng(31)
    base, passage = [sentence(rng, 120) for _ in range(4)], sentence(rng, 60)
    long = sentence(rng, 60_000)
    texts = [None, "", " \t\n", "word", base[0], base[0], base[0].replace(" ", "\n"), base[1] + " " + passage, passage + " mail a.b@example.org " + base[2], long, long + " end", "x" * 200_000, "\n" * 5000, "one\ntwo\nthree\n" * 400, "\U0001f600 é " * 30]
    rows = [(i, t, None if i % 5 == 1 else "en", None if i % 4 == 2 else f"s{i % 2}", None if i % 3 else 7) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (4, base[3], "en", "s0", 1), (None, base[1], None, None, None), (None, None, None, None, None), (None, base[1], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, "nothing of this stands anywhere at all today"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(None, 1, 0), (4, None, 0), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def ids(rows):
    return sorted(order(r.doc_id) for r in rows)


def test_exact(spark, hard):
    form = [(i, hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", t).encode()).hexdigest()) for i, t in rows_of(hard)]
    got = exact_dedup.exact_dedup(spark, hard).collect()
    assert sorted((order(r.doc_id), r.text_sha256, order(r.keep_id), r.group_size) for r in got) == sorted((order(i), x, min(order(j) for j, y in form if y == x), sum(y == x for _, y in form)) for i, x in form)


def test_lines(spark, hard):
    seen, want = set(), {}
    for i, t in sorted(set(rows_of(hard)), key=lambda r: (order(r[0]), spark.range(1).select(F.xxhash64(F.lit(r[1]), F.lit(1))).first()[0])):
        lines, gone = t.split("\n") if t else [], set()
        for p in range(len(lines) - 2):
            k = tuple(lines[p : p + 3])
            gone |= {p, p + 1, p + 2} if k in seen else set()
            seen.add(k)
        want[order(i), t] = (len(lines), len(gone), hashlib.sha256("\n".join(x for p, x in enumerate(lines) if p not in gone).encode()).hexdigest())
    got = [(order(r.doc_id), r.n_lines, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in line_dedup.line_dedup(spark, hard).collect()]
    assert sorted(got) == sorted((order(i), *want[order(i), t]) for i, t in rows_of(hard))


def test_substrings(spark, hard):
    got = substring_dedup.substring_dedup(spark, hard).collect()
    assert sorted((order(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed_words(rows_of(hard))


def test_jaccard(spark, hard):
    got = jaccard_join.jaccard_join(spark, hard).collect()
    assert sorted((order(r.doc_id), order(r.class_id), r.n_links) for r in got) == near(rows_of(hard))


def test_tokens(spark, hard):
    tokenizer = token_store.Encoder(token_store.tokenizer_path()).tokenizer
    want = sorted((-1 if i is None else i, zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, token_store.END], "<u4").tobytes())) for i, t in rows_of(hard))
    got = sorted(token_store.token_store(spark, hard).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == want
    assert [r.doc_id is None for r in got] == sorted((r.doc_id is None for r in got), reverse=True)


def test_pii(spark, hard):
    got = pii.find(hard).collect()
    assert ids(got) == sorted(order(i) for i, _ in rows_of(hard))
    want = sorted((order(i), hashlib.sha256(",".join(plain_spans(t)).encode()).hexdigest()) for i, t in rows_of(hard))
    assert sorted((order(r.doc_id), r.base_sha256) for r in got) == want


def test_leaks(spark, hard):
    item = rows_of(hard.where("doc_id = 7"))[0][1].split()[20:50]
    bench = spark.createDataFrame([(None, None, 1), (3, "", 1), (3, " ".join(item), 1), (3, " ".join(item), 1)], "item_id long, text string, doc_id int")
    got = decontaminate.leaks(spark, hard, bench, name="found").collect()
    assert got[0].asDict().keys() == {*hard.columns, "found"}
    for r in got:
        words = re.findall(r"[a-z0-9]+|[^\x00-\x7f]+", (r.text or "").lower())[:2000]
        assert r.found == ([3] if plain_edits(item, words) <= 6 else [])


def test_mixing(spark, hard):
    got = mixing.mix_sources(spark, hard).collect()
    assert sorted((order(r.doc_id), r.size) for r in got) == sorted((order(i), len(WORD.findall(t))) for i, t in rows_of(hard)) and all(r.taken <= 2 * r.size for r in got)


def test_quality(spark, hard, folder):
    rows, _, least = quality.select(spark, hard, spark.read.parquet(f"{folder}/labels.parquet"))
    got = rows.collect()
    assert ids(got) == sorted(order(i) for i, _ in rows_of(hard))
    tied = {}
    for r in got:
        tied.setdefault((r.doc_id, r.log_weight), set()).add(r.kept)
    assert all(len(x) == 1 for x in tied.values())


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", 5), (1, "http://a.net/x", 5), (None, "http://b.org/fr/" + "y" * 100_000, 5), (None, None, 5), (2, "", 5)], "page_id long, url string, rank int")
    got = url_filter.judge(spark, pages.withColumns({"rule": F.lit("r"), "verdict": F.lit("v"), "host": F.lit("h")}), url_filter.RULES).collect()
    assert sorted([(r.page_id, r.rule, r.verdict) for r in got], key=str) == sorted([(1, "net/", "block"), (1, "net/", "block"), (2, None, "allow"), (None, "org/fr/", "allow"), (None, None, "allow")], key=str)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages(spark, hard, folder, name, stage):
    out = stage(spark, hard, folder)
    assert out.columns == hard.columns and out.schema["node"].dataType == hard.schema["node"].dataType
    rows, had = out.collect(), {(r.doc_id, r.text) for r in hard.collect()}
    assert rows and all((r.doc_id, r.text) in had and r.node == "own node" and r.fairlead_log_weight == "own fairlead_log_weight" for r in rows)
    if name == "near_copies":  # one of each class; doc_id 4 is the least of two, with different texts
        assert len(rows) == len({x for _, x, _ in near(rows_of(hard))}) + 1 and len({r.text for r in rows if r.doc_id == 4}) == 2
    if name == "benchmark_leaks":
        assert len(rows) == hard.count()
    if name == "source_mix":
        words = sum(len(WORD.findall(r.text or "")) for r in rows)
        assert words == sum(r.taken for r in mixing.mix_sources(spark, hard).collect())


def test_empty(spark, hard, folder):
    none = spark.createDataFrame([], hard.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0, name
        assert name == "token_ids" or out.columns == hard.columns
