"""Nulls, empty texts, repeated rows, empty tables and clashing columns, for every operator; and brute force on small fixtures."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fairlead.llm import decontaminate, exact_dedup, jaccard_join, line_dedup, mixing, pii, quality, registry, substring_dedup, token_store, url_filter
from fairlead.llm.words import buffers, split

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    base, passage = [sentence(rng, 150) for _ in range(6)], sentence(rng, 70)
    texts = [None, "", " \n ", "one", "one  two\tthree", "one two three", "a b c d e f", "é\u00a0ü \U0001f600 word", base[0], base[0], base[0].replace(" ", "  "), base[1], " ".join(base[1].split()[:140]), base[2] + " " + passage, passage + "\n" + base[3], sentence(rng, 20) + " " + passage + " " + base[4], base[4] + "\n" + base[5], "x " * 5000, "x " * 4000]
    texts += [" ".join([*base[5].split()[:i], "new", *base[5].split()[i:]]) for i in (10, 60, 100)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(8, base[0], "en", "s0", 1), (None, base[1], "en", "s1", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def order(i):
    return substring_dedup.LAST if i is None else i


def test_words():
    texts = pa.array(["a bb\tc", None, "", "\n", "dé f", "g"], pa.large_string())
    words = split(*buffers(texts))
    got = [words.data[a:b].tobytes().decode() for a, b in zip(words.start, words.end, strict=True)]
    assert got == ["a", "bb", "c", "dé", "f", "g"] and words.doc_at.tolist() == [0, 3, 3, 3, 3, 5, 6]


def test_exact(spark, docs):
    form = {(i, t): hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", t).encode()).hexdigest() for i, t in rows_of(docs)}
    groups = {}
    for i, t in rows_of(docs):
        groups.setdefault(form[i, t], []).append(order(i))
    want = sorted((order(i), min(groups[form[i, t]]), len(groups[form[i, t]])) for i, t in rows_of(docs))
    got = exact_dedup.exact_dedup(spark, docs).collect()
    assert sorted((order(r.doc_id), order(r.keep_id), r.group_size) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_cuckoo():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (20_000, 4)).astype(np.uint64)
    index = exact_dedup.CuckooIndex(expected=64)
    for part in np.array_split(keys, 7):
        assert (index.find(part) < 0).all()
        index.insert(part)
    assert (index.find(keys) == np.arange(len(keys))).all() and index.buckets * exact_dedup.SLOTS >= len(keys)
    assert index.delete(keys[:5000]).all() and (index.find(keys[:5000]) < 0).all() and (index.find(keys[5000:]) >= 0).all()
    assert not index.delete(keys[:10]).any()
    index.insert(keys[:5000])
    assert (index.find(keys) >= 0).all()


def test_lines(spark):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\ny", "a\nb", "q\nb\nc\nd\na\nb\nc", None, "", "z\nz\nz\nz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.line_dedup(spark, docs).collect()}
    assert got == {0: (4, 0, "a\nb\nc\nd"), 1: (5, 3, "x\ny"), 2: (2, 0, "a\nb"), 3: (7, 6, "q"), 4: (0, 0, ""), 5: (0, 0, ""), 6: (4, 3, "z")}


@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_runs(spark, run):
    rng = np.random.default_rng(4)
    texts = ["\n".join(rng.choice(["hot", "", "a", "b", *map(str, range(40))], int(rng.integers(1, 9)))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, want = set(), {}
    for i, t in enumerate(texts):
        lines, gone = t.split("\n") if t else [], set()
        for p in range(len(lines) - run + 1):
            k = tuple(lines[p : p + run])
            gone |= set(range(p, p + run)) if k in seen else set()
            seen.add(k)
        want[i] = (len(lines), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.line_dedup(spark, docs, run).collect()} == want


def test_line_fingerprints(spark, monkeypatch):
    """One row for each window's rightmost minimum, fewer than windows; hashes that occur once go; without their selection rows differ."""
    rng = np.random.default_rng(6)
    texts = ["\n".join(map(str, rng.integers(0, 2000, 40))) for _ in range(20)]
    texts += [texts[0], "\n".join(texts[1].split("\n")[3:20]), None, "one\ntwo"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, p int")
    rows = line_dedup.fingerprints(docs).collect()
    ends = {(r.doc_id, w.at): r.p for r in rows for w in r.windows}
    lines = {x: h for x, h in spark.createDataFrame([(str(i),) for i in range(2000)], "x string").selectExpr("x", "xxhash64(x) AS h").collect()}
    for i, t in enumerate(texts[:22]):
        h = [lines[x] for x in t.split("\n")]
        for at in range(len(h) - 2):
            assert ends[i, at] == min(range(at, at + 3), key=lambda p: (h[p], -p))
    table = line_dedup.fingerprints(docs)
    assert len(rows) < 0.7 * len(ends) and 40 < line_dedup.matched(table).count() < len(rows)
    want = sorted(map(tuple, line_dedup.repeated_runs(spark, docs).collect()))
    assert [r[0] for r in want] == [20, 21] and want[0][2] == list(range(38)) and want[1][2] == list(range(15))
    monkeypatch.setattr(line_dedup, "matched", lambda t: t.withColumn("f", t["p"]))  # positions in place of hashes: the join loses the matches
    assert sorted(map(tuple, line_dedup.repeated_runs(spark, docs).collect())) != want


def removed_words(rows, window=50):
    least = {}
    words = [(order(i), WORD.findall(t)) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, w in words:
        gone = {q for p in range(len(w) - window + 1) if least[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substrings(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    got = substring_dedup.substring_dedup(spark, docs).collect()
    assert sorted((order(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed_words(rows_of(docs))


def test_substring_collisions(spark):
    """Words of two letters whose bytes balance in any polynomial modulo 2**64, and their complements, are different words."""
    parity = [bin(i).count("1") % 2 for i in range(1024)]
    rng = np.random.default_rng(7)
    one, two = ("".join("ab"[b ^ k] for b in parity) for k in (0, 1))
    left, right = sentence(rng, 28), sentence(rng, 28)
    docs = spark.createDataFrame([(1, f"{left} {one} {right}"), (2, f"{left} {two} {right}"), (3, f"{left} {one} {right}")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(spark, docs).collect()}
    assert got == {1: 0, 2: 0, 3: 57}
    words = split(*buffers(pa.array([f"{one} {two} {one[:64]} {two[:64]} {one[:9]} {two[:9]} a b"], pa.large_string())))
    assert len(set(words.hashes().tolist())) == 8


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.NET/en/1?x#y", "http://a.net", "http://a.net/", "http://example.com/de/x", "http://example.com/de", "https://x.org/fr/", "http://net/en/", "http://xnet/", "a://b://c/d", "http://É.net/ü"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark, spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.RULES, block=3).collect()}
    want = [("", "", None, "allow")] * 3 + [("www.example.net", "/en/1", "example.net/en/", "allow"), ("a.net", "", None, "allow"), ("a.net", "/", "net/", "block"), ("example.com", "/de/x", "example.com/de/", "block"), ("example.com", "/de", None, "allow"), ("x.org", "/fr/", "org/fr/", "allow"), ("net", "/en/", "net/", "block"), ("xnet", "/", None, "allow"), ("b:", "//c/d", None, "allow"), ("É.net", "/ü", "net/", "block")]
    assert [got[i] for i in range(len(urls))] == want


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(rows):
    """Class and number of links of each row."""
    sets = [shingles(t) for _, t in rows]
    linked = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0}
    root = list(range(len(rows)))
    for _ in rows:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    least = {r: min(order(rows[i][0]) for i in range(len(rows)) if root[i] == r) for r in root}
    return sorted((order(rows[i][0]), least[root[i]], sum(i in x for x in linked)) for i in range(len(rows)))


@pytest.mark.parametrize("small", [1000, 2])
def test_jaccard(spark, docs, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", small)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 100 * small)
    got = jaccard_join.jaccard_join(spark, docs).collect()
    assert sorted((order(r.doc_id), order(r.class_id), r.n_links) for r in got) == near(rows_of(docs))


def test_jaccard_recall(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(150):
        w = sentence(rng, 120).split()
        other = [*w[: int(rng.integers(0, 20))], *w[int(rng.integers(0, 5)) :]]
        other[60] = "changed"
        texts += [" ".join(w), " ".join(other)]
    want = near(list(enumerate(texts)))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert sum(n for *_, n in got) >= 0.99 * sum(n for *_, n in want) > 0


def test_jaccard_path_recall():
    """Other pairs at the threshold than those that set the number of runs, with every node split DEPTH times below the roots."""
    rng, pairs, count = np.random.default_rng(16), 600, jaccard_join.runs()
    first = rng.integers(0, 1 << 32, (pairs, jaccard_join.TOKENS), dtype=np.uint32)
    second = np.where(rng.random(first.shape) < jaccard_join.SIMILARITY, first, rng.integers(0, 1 << 32, first.shape, dtype=np.uint32))
    tokens = pa.array([x.astype("<u4").tobytes() for x in np.stack([first, second], 1).reshape(-1, jaccard_join.TOKENS)], pa.binary())
    rows = list(jaccard_join._roots(count)([pa.RecordBatch.from_arrays([pa.array(np.arange(2 * pairs)), tokens], names=["node", "tokens"])]))
    for depth in range(jaccard_join.DEPTH + 1):
        path, node = np.unique(np.stack([np.concatenate([r[c].to_numpy() for r in rows]) for c in ("path", "node")]), axis=1)
        same = np.flatnonzero((path[1:] == path[:-1]) & (node[1:] // 2 == node[:-1] // 2))
        kept = np.unique(np.concatenate([same, same + 1]))
        path, node = path[kept], node[kept]
        if depth < jaccard_join.DEPTH:
            rows = list(jaccard_join._children([pa.RecordBatch.from_arrays([pa.array(path), pa.array(node), tokens.take(pa.array(node))], names=["path", "node", "tokens"])]))
    assert len(np.unique(node // 2)) >= jaccard_join.RECALL * pairs
    with pytest.raises(ValueError, match="the target is 2"):
        jaccard_join.runs(2.0, 10)


def test_jaccard_recall_split(spark, monkeypatch):
    """Measured through Spark, at similarities near the threshold, with every node of more than two sets split."""
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    rng, texts = np.random.default_rng(9), []
    for _ in range(60):  # groups of four that differ in places of their own
        w = sentence(rng, 200).split()
        for _ in range(4):
            other = list(w)
            for i in rng.choice(200, int(rng.integers(2, 5)), replace=False):
                other[i] = "changed"
            texts.append(" ".join(other))
    want = near(list(enumerate(texts)))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert sum(n for *_, n in got) >= 0.99 * sum(n for *_, n in want) > 0


@pytest.mark.parametrize("large", [1 << 17, 190, 0])
def test_common(monkeypatch, large):
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    monkeypatch.setattr(jaccard_join, "WIDTH", 100)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 3000, 200)).astype(np.uint64) for _ in range(50)]
    sets += [np.unique(np.append(rng.choice(x, 180, replace=False), rng.integers(0, 3000, 10).astype(np.uint64))) for x in sets]
    for cut in (0, 37):
        got = jaccard_join.common(sets, cut)
        for i, j in itertools.product(range(100), range(100)):
            if not cut or i < cut <= j:
                n = len(np.intersect1d(sets[i], sets[j]))
                possible = large == 1 << 17 or n >= 0.8 * len(np.union1d(sets[i], sets[j]))
                assert got[i, j] == n if possible else got[i, j] in (0, n)


def test_leaks(spark):
    rng = np.random.default_rng(9)
    items = [sentence(rng, n) for n in (12, 30, 65, 8, 40)]
    inside = [sentence(rng, 200) for _ in range(4)]
    words = items[1].split()
    edited = " ".join([*words[:4], "zz", *words[5:20], *words[21:28], "yy", *words[28:]])  # three edits, six allowed
    texts = [inside[0], inside[1] + " " + items[0].upper() + ". " + inside[0], edited, inside[2] + "\n" + edited + " " + inside[3], " ".join(words[:20]), None, "", items[2] + " " + items[3]]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, item_ids int")
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, ""), (None, "x")], "item_id long, text string")
    for block in (20_000, 2):
        got = {r.doc_id: list(r[decontaminate.FOUND]) for r in decontaminate.leaks(spark, docs, bench, block).collect()}
        assert got == {0: [], 1: [0], 2: [1], 3: [1], 4: [], 5: [], 6: [], 7: [2, 3]}


def test_leak_null_id(spark):
    rng = np.random.default_rng(10)
    items = [sentence(rng, 30) for _ in range(3)]
    texts = [items[0], items[1] + " " + items[2] + " " + items[0], sentence(rng, 50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(None, items[0]), (-3, items[1]), (None, items[2])], "item_id long, text string")
    for block in (20_000, 1):
        got = {r.doc_id: list(r[decontaminate.FOUND]) for r in decontaminate.leaks(spark, docs, bench, block).collect()}
        assert got == {0: [None], 1: [-3, None], 2: []}


def test_leak_recall():
    rng = np.random.default_rng(8)
    items = decontaminate.Items(list(range(150)), [sentence(rng, int(n)) for n in rng.integers(10, 70, 150)])
    edited = items._edited(np.random.default_rng(77))
    found = items.search(np.concatenate([w for _, w in edited]), np.cumsum([0] + [len(w) for _, w in edited]))
    assert np.mean([i in found.get(d, ()) for d, (i, _) in enumerate(edited)]) >= 0.9


def test_leak_walks(monkeypatch):
    rng = np.random.default_rng(13)
    texts = [sentence(rng, int(n)) for n in rng.integers(10, 40, 60)]
    monkeypatch.setattr(decontaminate, "BANDS", 1)  # each walk finds less
    items = decontaminate.Items([None] * 60, texts)
    assert items.walks > 6 and set(items.ids) == {None}
    monkeypatch.setattr(decontaminate, "MOST_WALKS", 1)
    with pytest.raises(ValueError, match="the target is 0.95"):
        decontaminate.Items(list(range(60)), texts)


def plain_edits(item, words):
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        row = [i] + [min(row[j] + (x != y), row[j + 1] + 1) for j, y in enumerate(words)]
        for j in range(1, len(row)):
            row[j] = min(row[j], row[j - 1] + 1)
    return min(row)


def test_edits():
    assert decontaminate.edits(np.array([1, 2, 3, 4]), np.array([9, 1, 2, 4, 9]), 4) == 1 and decontaminate.edits(np.array([1, 2]), np.array([3]), 2) == 2
    rng = np.random.default_rng(1)
    for _ in range(300):
        item, words = (rng.integers(0, 4, int(rng.integers(1, 15))) for _ in range(2))
        n = plain_edits(item.tolist(), words.tolist())
        assert decontaminate.edits(item, words, 20) == n and decontaminate.edits(item, words, 2) == min(n, 3)


def test_leak_blocks(monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    rows = [(1, "a" * 4), (2, None), (3, "b" * 7), (4, "c" * 50), (5, ""), (6, "d")]
    assert [[r[0] for r in x] for x in decontaminate.blocks(iter(rows), 3)] == [[1, 2], [3], [4], [5, 6]]
    assert [[r[0] for r in x] for x in decontaminate.blocks(iter(rows[:2]), 1)] == [[1], [2]]


def test_leaks_brute_force(spark):
    """Random documents, many with an edited item: none found that isn't within the limit, and nearly all that are."""
    rng = np.random.default_rng(15)
    items = [sentence(rng, int(n)).split() for n in rng.integers(6, 150, 25)]
    texts = []
    for k in range(200):
        w, i = list(items[k % 25]), k % 25
        for _ in range(int(rng.integers(0, int(len(w) * 0.2) + 3)) if k < 150 else 0):
            at, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
            w[at : at + (kind != 1)] = [sentence(rng, 1)] if kind != 2 else []
        around = [sentence(rng, int(rng.integers(0, 60))).split() for _ in range(2)]
        texts.append(around[0] + (w if k < 175 else []) + around[1])
    docs = spark.createDataFrame([(k, " ".join(t), "x") for k, t in enumerate(texts)], "doc_id long, text string, fairlead_item_ids string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, i) for r in decontaminate.leaks(spark, docs.drop("fairlead_item_ids"), bench, 10).collect() for i in r[decontaminate.FOUND]}
    want = {(k, i) for k, t in enumerate(texts) for i, w in enumerate(items) if plain_edits(w, t) <= int(len(w) * 0.2 + 1e-9)}
    assert 80 < len(want) < 175 and got <= want and len(got) >= 0.95 * len(want)


def plain_spans(text):
    out = []
    for kind, _, pattern, *_ in pii.KINDS[:4]:
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0 if digits else False
            good = {"email": True, "ip": all(int(x or 0) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark):
    texts = [None, "", "é\U0001f600 a@b.c_x@d.e.f y@z", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (706) 555-3138 +1 2 +12345678901234567890", "GB82WEST12345698765432 GB83WEST12345698765432", "ssn 123-45-6789, 123-45-6789" + " " * 50 + "123-45-6789", "123-45-6789 is my tax number", "9" * 30_000 + "@", "a" * 30_000 + "@" + "b." * 5000 + "c"]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, spans string, v string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for i, t in enumerate(texts):
        spans = plain_spans(t or "")
        assert [s for s in got[i].spans.split(",") if s.split(":")[0] in pii.BASE] == spans
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s.startswith(k + ":") for s in spans) for k in pii.BASE]
    assert "iban:0:22" in got[6].spans and "iban:23" not in got[6].spans
    assert got[7].spans == "id:4:15"  # the others have no context word between the matches beside them
    assert got[8].spans == "id:0:11" and got[8].scores == "0.6"


def test_targets():
    t = mixing.targets({"a": 100, "b": 100, "c": 100, "d": 10, None: 50})
    assert sum(t.values()) == pytest.approx(540) and t["a"] == 200 and t["d"] == 20
    assert all(v <= 2 * {"d": 10, None: 50}.get(k, 100) + 1e-9 for k, v in t.items())
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_fit():
    rng = np.random.default_rng(4)
    for _ in range(30):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 400, 30), rng.integers(1, 20, 30), strict=True)}
        total = sum(n * c for n, c in counts.items())
        budget = int(rng.integers(0, total))
        take = mixing.fit(counts, budget, 1)
        assert all(0 <= c <= counts[n] for n, c in take.items())
        reach = 1
        for n, c in counts.items():
            for _ in range(c):
                reach |= reach << n
        best = min(abs(v - budget) for v in range(total + 1) if reach >> v & 1)
        assert abs(sum(n * c for n, c in take.items()) - budget) <= best + 2


def test_fit_beyond_dp():
    """Budgets far above DP_WORDS are met exactly while small documents are left, and giant documents don't make large tables."""
    rng = np.random.default_rng(5)
    for big in (0, 10**7):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 3000, 200), rng.integers(1, 500, 200), strict=True)} | ({big: 3} if big else {})
        total = sum(n * c for n, c in counts.items())
        for budget in (total // 3, total // 2 + 12_345, total // 10 * 9, mixing.DP_WORDS * 5 + 1):
            take = mixing.fit(counts, budget, 3)
            assert all(0 <= c <= counts[n] for n, c in take.items())
            assert abs(sum(n * c for n, c in take.items()) - budget) <= min(n for n in counts if n) + 3
    assert mixing.fit({10**6: 5}, 10**6 + 400_000, 1) == {10**6: 1} and mixing.fit({10**6: 5}, 600_000, 1) == {10**6: 1}


def test_mix_stage_repeats(spark, tmp_path):
    """Rows that share a doc_id, with equal and with other texts: the stage emits as many words as the mix takes."""
    rows = [(i, f"w {'x ' * (i % 5)}", "a" if i % 3 else None) for i in range(60)] + [(7, "one two three", "a")] * 5 + [(7, "four five six", "a")] * 3 + [(None, "p q", "b")] * 4
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, copies int")
    want = sum(r.taken for r in mixing.mix_sources(spark, docs).collect())
    out = mixing.stage(spark, docs, "")
    got = out.collect()
    assert out.columns == docs.columns and sum(len(WORD.findall(r.text)) for r in got) == want
    assert sorted(map(str, got)) == sorted(map(str, mixing.stage(spark, docs.repartition(5), "").collect()))


def test_mix(spark, docs):
    got = mixing.mix_sources(spark, docs).collect()
    again = mixing.mix_sources(spark, docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    rows = docs.collect()
    assert sorted((order(r.doc_id), r.size) for r in got) == sorted((order(r.doc_id), len(WORD.findall(r.text or ""))) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= max(r.size for r in got if r.target == target) / 2 + 1


def test_tokens(spark, docs):
    tokenizer = token_store.Encoder(token_store.tokenizer_path()).tokenizer
    got = sorted(token_store.token_store(spark, docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda i: -1 if i is None else i)
    start = 0
    texts = {}
    for i, t in rows_of(docs):
        texts.setdefault(i, set()).add(t)
    for r in got:
        assert r.start == start
        start += r.n_tokens
        crcs = {zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, token_store.END], "<u4").tobytes()) for t in texts[r.doc_id]}
        assert r.ids_crc32 in crcs


def test_levels():
    rng = np.random.default_rng(0)
    for high in (200, 60_000, 2**32 - 1):
        ids = rng.integers(0, high, 3000).astype(np.uint32)
        levels = token_store.encode_levels(ids)
        assert (token_store.decode_levels(levels) == ids).all()
        assert all(token_store.access(levels, int(i)) == ids[i] for i in rng.integers(0, 3000, 300))
    assert len(token_store.decode_levels(token_store.encode_levels(np.zeros(0, np.uint32)))) == 0


def test_encoder_cuts():
    e = token_store.Encoder(token_store.tokenizer_path())
    texts = ["", " a  b", "x \n y", "\n\n a", " lead", "trail ", "it's 'll 123 $$ !a<|endoftext|>b c", "\x85 a", "a\x1c b", "don't  stop\t\tnow ", "日本 語 x", "<|endoftext|>", "a<|endoftext|><|endoftext|> \n", "é\u2003 é\u00a0 é\u3000\u3000x", "a\n\u00a0b\n'sx", None]
    rng = np.random.default_rng(1)
    signs = [*"abZ09.,$'\"-<|> \n\t\r\x0b\x1c\x1f", "  ", "\n\n", "'s", "'ll", "\u00a0", "\u2003", "\u3000", "\x85", "é", "—", "日", "\U0001f600", "<|endoftext|>", "\u200b", "²"]
    texts += ["".join(rng.choice(signs, int(rng.integers(1, 30)))) for _ in range(3000)]
    for lo in (0, 20):  # the second time, all pieces are known
        ids, at = e.batch(pa.array(texts[lo:]))
        for t, a, b in zip(texts[lo:], at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, token_store.END], t


def test_encoder_cache(monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_BYTES", 4000)
    e, rng = token_store.Encoder(token_store.tokenizer_path()), np.random.default_rng(2)
    for _ in range(20):
        texts = [" ".join(rng.choice(["the", "same", "words", *map(str, range(300))], 60)) for _ in range(5)]
        ids, at = e.batch(pa.array(texts))
        assert all(ids[a:b].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, token_store.END] for t, a, b in zip(texts, at[:-1], at[1:], strict=True))


def test_crc_parts():
    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (5, 0), (7, 70_000), (70_000, 3)):
        a, b = rng.bytes(n), rng.bytes(m)
        assert token_store.crc_shift(zlib.crc32(a), m) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("page", [16, 1 << 13])
def test_fetch(spark, docs, tmp_path, monkeypatch, page):
    """Any token of any document, from its page alone, equals the plain encoding; documents span many small pages."""
    monkeypatch.setattr(token_store, "PAGE", page)
    once = docs.dropDuplicates(["doc_id"]).coalesce(1)
    token_store.write_store(spark, once.withColumn("levels", F.lit(1)), f"{tmp_path}/s")
    tokenizer, rng = token_store.Encoder(token_store.tokenizer_path()).tokenizer, np.random.default_rng(4)
    for doc, text in rows_of(once)[::3]:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, token_store.END]
        for i in {0, len(ids) - 1, int(rng.integers(0, len(ids)))}:
            assert token_store.fetch(spark, f"{tmp_path}/s", doc, i) == ids[i]
        assert token_store.fetch(spark, f"{tmp_path}/s", doc, len(ids)) is None
    assert token_store.fetch(spark, f"{tmp_path}/s", 10**9, 0) is None


def test_quality(spark):
    rng = np.random.default_rng(6)
    good = [" ".join(str(w).capitalize() if k % 9 == 0 else w for k, w in enumerate(sentence(rng, 60).split())) + "." for _ in range(200)]
    bad = ["$$$ ".join(sentence(rng, 60).split()) for _ in range(60)]
    texts = [*good, *bad, None, ""]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, log_weight double")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 260, 2)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.select(spark, docs, labels)[0].collect()}
    held = [i for i in range(260) if i % 2]  # not labelled at all
    assert np.mean([kept[i] == (i < 200) for i in held]) >= 0.97 and len(kept) == 262
    assert all(r.kept for r in quality.select(spark, docs, labels.where("quality = 9"))[0].collect())


def test_quality_plain(spark):
    """Counts, log weights, cut, keys and the k kept, computed plainly from n-grams and sets."""
    rng = np.random.default_rng(21)
    texts = [None, "", "x", "same same same", *(" ".join(rng.choice(["Good", "fine.", "words", "and", "more"], int(rng.integers(3, 30)))) for _ in range(60)), *(" ".join(rng.choice(["$$$", "BUY", "now!!", "words"], int(rng.integers(3, 30)))) for _ in range(40))]
    texts += [texts[10], texts[90]]
    docs = spark.createDataFrame([(i if i != 30 else None, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    labels = {i: int(i < 64) for i in range(4, 104, 2)}
    rows, model, least = quality.select(spark, docs, spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int"))
    got = {(r.doc_id, round(r.log_weight, 6), r.kept) for r in rows.collect()}
    sample = [r[0] for r in spark.createDataFrame([(i,) for i in labels], "i long").orderBy(F.xxhash64("i", F.lit(quality.SEED)), "i").collect()]

    def grams(t):  # buckets of one text
        return quality.features(pa.array([t], pa.large_string()))[0].tolist()

    def shape(t):
        return "".join("a" if ord(c) >= 0x80 or c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in t)

    seen = {}
    for t in texts:  # equal n-grams share a bucket; n-grams are counted as often as they come
        forms = [shape(t or "")[i : i + 4] for i in range(len(t or "") - 3)]
        words = (t or "").split()
        forms += ["same" if a == b else (a, b) for a, b in itertools.pairwise(words)]
        assert len(grams(t)) == len(forms)
        for form, bucket in zip(forms, grams(t), strict=True):
            assert seen.setdefault(form, bucket) == bucket
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    good = {i for i in sample[::2] if labels[i] == 1}
    for i, t in enumerate(texts):
        for b in grams(t):
            raw[b] += 1
            target[b] += i in good and i != 30
    weight = [round(sum(np.log((target[b] + 1) / (target.sum() + quality.BUCKETS)) - np.log((raw[b] + 1) / (raw.sum() + quality.BUCKETS)) for b in grams(t)), 6) for t in texts]
    held = [i for i in sample[1::2] if i != 30]
    at = sorted({weight[i] for i in held})
    cuts = [at[0] - 1] + [(a + b) / 2 for a, b in itertools.pairwise(at)]
    ones, zeros = [weight[i] for i in held if labels[i]], [weight[i] for i in held if not labels[i]]
    loss = [quality.GOOD_COUNTS * sum(w < c for w in ones) / len(ones) + sum(w >= c for w in zeros) / len(zeros) for c in cuts]
    wide = {c: b - a for c, a, b in zip(cuts[1:], at, at[1:], strict=False)} | {cuts[0]: 0}
    cut = max((c for c, x in zip(cuts, loss, strict=True) if x <= min(loss) + 1e-9), key=lambda c: wide[c])
    noise = {r.i: (((r.h & (1 << 64) - 1) >> 11) + 0.5) / (1 << 53) for r in spark.createDataFrame([(i if i != 30 else None,) for i in range(len(texts))], "i long").select("i", F.xxhash64("i", F.lit(quality.SEED + 1)).alias("h")).collect()}
    keys = [w - np.log(-np.log(noise[i if i != 30 else None])) for i, w in enumerate(weight)]
    k = sum(w >= cut for w in weight)
    top = sorted(keys, reverse=True)[k - 1]
    assert got == {(i if i != 30 else None, w, x >= top - 1e-9) for i, (w, x) in enumerate(zip(weight, keys, strict=True))} and 0 < k < len(texts)


def test_kth(spark):
    rng = np.random.default_rng(1)
    values = [float(v) for v in np.concatenate([rng.normal(0, 1, 3000), np.full(500, 7.0), [1e9, -1e9]])]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 300, 501, 502, 3000):
        assert quality.kth_largest(df, "v", k, few=100, bins=50) == sorted(values, reverse=True)[k - 1]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.exact_dedup(spark, none).count() == 0
    assert line_dedup.line_dedup(spark, none).count() == 0
    assert substring_dedup.substring_dedup(spark, none).count() == 0
    assert jaccard_join.jaccard_join(spark, none).count() == 0
    assert decontaminate.leaks(spark, none, bench).count() == 0
    assert decontaminate.leaks(spark, docs, bench.limit(0)).where(F.size(decontaminate.FOUND) > 0).count() == 0
    assert pii.find(none).count() == 0
    assert mixing.mix_sources(spark, none).count() == 0
    assert quality.select(spark, none, labels)[0].count() == 0
    assert token_store.token_store(spark, none).count() == 0
    assert url_filter.judge(spark, spark.createDataFrame([], "page_id long, url string"), url_filter.RULES).count() == 0


def test_registry():
    names = registry.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(12)
    item = sentence(rng, 25)
    clean = [". ".join(sentence(rng, 12).capitalize() for _ in range(8)) + "." for _ in range(60)]
    texts = [*clean, clean[3], " ".join([*clean[5].split()[:90], "new", *clean[5].split()[90:]]), clean[7] + " " + item, *["$$$ ".join(sentence(rng, 60).split()) for _ in range(20)]]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t), "extra") for i, t in enumerate(texts)], DOCS + ", kept string")
    for name, df in (("documents", docs), ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string")), ("labels", spark.createDataFrame([(i, int(i < 63), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "token_ids":
            assert now.columns == before.columns
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
    assert seen[0] == set(range(63)) and seen[1] == seen[0] - {60, 61} and seen[2] == seen[1] - {62}
    mixed = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/source_mix").collect()]
    assert sorted(mixed) == sorted(r.doc_id for r in now.collect()) and max(map(mixed.count, mixed)) == 2
