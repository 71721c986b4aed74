"""Exact, SimHash and line dedup, and components."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lectern.llm import components, exact_dedup, golay, line_dedup, simhash_dedup


def test_components(spark, union_find):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(700, i) for i in range(600, 700)] + [(900, 900)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == union_find([e for e in edges if e[0] != e[1]], nodes)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    low = lambda d: -1 if d is None else d
    return sorted((low(r.doc_id), low(max(g, key=low)), len(g), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows for g in [groups[r.text or ""]])


@pytest.mark.parametrize("table", ["tiny", "edge", "crafted"])
def test_exact(spark, table, request):
    if table == "crafted":
        b = exact_dedup.BLOCK
        base = "".join(random.Random(1).choices("ab\n ü", k=5 * b))
        texts = [base, base[:-1], base[:-1] + "z", base, base[:b], base[:b], base[b:], "x" * b * 3, "x" * b * 3, "x" * (b * 3 + 1), base[:b] + base[:b], base[:b] * 2, "", None]
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    else:
        docs = request.getfixturevalue(table)
    got = exact_dedup.exact_dedup(docs).collect()
    low = lambda d: -1 if d is None else d
    i, j = docs.columns.index("doc_id"), docs.columns.index("text")
    rows = docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).selectExpr(f"c{i} AS doc_id", f"c{j} AS text").collect()
    assert sorted((low(r.doc_id), low(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute_exact(rows)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_empty_and_normalised(spark, empty):
    from pyspark.sql import functions as F

    assert exact_dedup.exact_dedup(empty).count() == 0
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(docs, F.lower("text")).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (3, True)}


def brute_fingerprint(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_links(fps):
    fps = sorted(set(fps))
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(a ^ b).count("1") <= 3]


def check_near(docs, union_find):
    got = simhash_dedup.near_groups(docs).collect()
    i, j = docs.columns.index("doc_id"), docs.columns.index("text")
    rows = docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).selectExpr(f"c{i} AS doc_id", f"c{j} AS text").collect()
    fp = [brute_fingerprint(r.text) for r in rows]
    of = union_find(brute_links(fp), set(fp))
    least = {}
    for r, f in zip(rows, fp, strict=True):
        if r.doc_id is not None:
            least[of[f]] = min(least.get(of[f], r.doc_id), r.doc_id)
    low = lambda d: -1 if d is None else d
    want = sorted((low(r.doc_id), f, low(least.get(of[f]))) for r, f in zip(rows, fp, strict=True))
    assert sorted((low(r.doc_id), r.fp % 2**64, low(r.component_id)) for r in got) == want
    return want


def test_near_groups(spark, tiny, edge, empty, union_find):
    want = check_near(tiny, union_find)
    assert any(d != c for d, _, c in want)
    check_near(edge, union_find)
    assert simhash_dedup.near_groups(empty).count() == 0


def test_near_copies_stay_once(spark, tiny):
    text = tiny.where("n_chars > 3000").first().text.split(" ")
    rows = [(0, " ".join(text))]
    for i in range(1, 60):
        words = list(text)
        words[(i * 7) % len(words)] = f"w{i}"
        rows.append((i, " ".join(words)))
    got = [r.doc_id for r in simhash_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert 0 in got and len(got) <= 6


def test_pipeline_drops_what_is_similar(spark, tiny, edge, empty, union_find):
    """Groups against the Jaccard similarities of all pairs, for copies with 0.5 to 6 % of words changed."""
    import corpus_pipeline

    rng = random.Random(8)
    base = [r.text.split() for r in tiny.where("n_chars BETWEEN 800 AND 4000").orderBy("doc_id").limit(25).collect()]
    texts = [" ".join(w) for w in base]
    for w in base:
        for share in (0.005, 0.01, 0.02, 0.03, 0.06):
            copy = list(w)
            for k in rng.sample(range(len(w)), max(1, round(share * len(w)))):
                copy[k] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for t in texts)]
    edges = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(edges) > 80
    fps = [brute_fingerprint(t, 5) for t in texts]
    edges += [(i, j) for j in range(len(texts)) for i in range(j) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    want = {i for i, c in union_find(edges, range(len(texts))).items() if i == c}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == want
    assert corpus_pipeline.near_copies(spark, empty, "").count() == 0
    plain, similar = (sorted(r.fp for r in simhash_dedup.near_groups(edge, 3, s).collect()) for s in (None, 0.8))
    assert plain == similar


def test_golay_decodes_to_the_nearest_codeword():
    words = np.arange(4096) << 11
    assert len(set(golay.decode(words).tolist())) <= 4096
    rng = np.random.default_rng(0)
    codewords = np.array([w for w in range(1 << 23) if False] or [], np.int64)
    w = rng.integers(0, 1 << 23, 2000)
    low, high, error = golay._tables()
    nearest = w ^ error[low[w & 0xFFF] ^ high[w >> 12]]
    assert not (low[nearest & 0xFFF] ^ high[nearest >> 12]).any()
    assert max(bin(int(x)).count("1") for x in w ^ nearest) <= 3
    assert set((golay.near(w) >= 0).sum(1).tolist()) == {1, 6}
    one = w ^ (1 << rng.integers(0, 23, 2000))
    assert all(a in b for a, b in zip(golay.decode(one).tolist(), golay.near(w).tolist(), strict=True))
    assert not len(codewords)


def found(fps, monkeypatch=None, cap=None):
    if cap:
        monkeypatch.setattr(simhash_dedup, "CAP", cap)
    t = pa.Table.from_batches(simhash_dedup.keys([pa.record_batch([pa.array(fps)], ["fp"])])).select(["key", "fp"]).sort_by("key")
    e = pa.Table.from_batches(simhash_dedup.links(t.to_batches(max_chunksize=997)))
    return set(zip(e["a"].to_pylist(), e["b"].to_pylist(), strict=True))


@pytest.mark.parametrize("flips", [1, 2, 3])
def test_every_link_meets_under_a_key(flips):
    rng = np.random.default_rng(flips)
    fp = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    other = fp.copy()
    for i in range(len(fp)):
        for b in rng.choice(64, flips, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    pairs = {(max(a, b), min(a, b)) for a, b in zip(fp.view(np.int64).tolist(), other.view(np.int64).tolist(), strict=True)}
    assert found(np.unique(np.concatenate([fp, other]).view(np.int64))) >= pairs


def cluster(n=700, bits=14):
    rng = np.random.default_rng(5)
    return np.unique([0x1234567890ABCDEF ^ sum(1 << int(3 * b) for b in rng.choice(bits, 5, replace=False)) for _ in range(n)]).astype(np.int64)


def test_clusters_give_forests_not_pairs(union_find):
    fps = cluster()
    edges = found(fps)
    assert union_find(edges, fps.tolist()) == union_find([(a, b) for a, b in brute_links(fps.tolist())], fps.tolist())
    a, b = simhash_dedup.forest(fps)
    assert len(a) < len(fps)


def test_crowded_keys_go_another_exact_way(spark, union_find, monkeypatch):
    fps = cluster(400)
    edges = found(fps, monkeypatch, cap=40)
    over = {a for a, b in edges if a == b}
    assert over
    more = {(r.a, r.b) for r in simhash_dedup._balls(spark.createDataFrame([(x,) for x in over], "fp long")).collect()}
    assert all(bin((a ^ b) % 2**64).count("1") <= 3 for a, b in more)
    want = union_find(brute_links(fps.tolist()), fps.tolist())
    assert union_find(more | {e for e in edges if e[0] != e[1]}, fps.tolist()) == want


def test_the_rest_of_a_crowded_key_stays_crowded(monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CAP", 40)
    monkeypatch.setattr(simhash_dedup, "WINDOW", 60)
    fps = np.arange(65, dtype=np.int64)
    batches = [pa.record_batch([pa.array(np.full(len(x), 7, np.int32)), pa.array(x)], ["key", "fp"]) for x in (fps[:60], fps[60:])]
    edges = {(a, b) for e in simhash_dedup.links(batches) for a, b in zip(e["a"].to_pylist(), e["b"].to_pylist(), strict=True)}
    assert edges >= {(x, x) for x in range(65)}


def brute_lines(rows):
    """The lines that stay of each text, by the edit similarity of all pairs alone."""
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()

    def alike(a, b):
        v, w = a.split(" "), b.split(" ")
        if min(len(v), len(w)) >= 48 and len({*v} & {*w}) < max(len({*v}), len({*w})) / 2:
            return False
        most = int(max(len(a), len(b)) * 0.2 + 1e-9)
        return abs(len(a) - len(b)) <= most and edits(a, b) <= most

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    first, root = {}, {}
    for i, text in enumerate(rows):
        for p, x in enumerate((text or "").split("\n")):
            if norm(x):
                first.setdefault(norm(x), (i, p))
    keys = list(first)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if alike(a, b):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y, key=first.get)] = min(x, y, key=first.get)
    stay = {first[k] for k in keys if find(k) == k}
    return ["\n".join(x for p, x in enumerate(t.split("\n")) if not norm(x) or (i, p) in stay) if t is not None else None for i, t in enumerate(rows)]


def test_near_dedup_keeps_rows_not_ids(spark, edge, empty):
    """Unrelated texts without an id, or with one id, all stay; clashing names do no harm."""
    texts = ["the first of several texts that have nothing in common", "winter came early and snow lay on all roads for weeks", "a recipe calls for flour butter sugar and four eggs", "ships left the harbour before noon in heavy fog", "prime numbers have no divisors but one and themselves", "her violin was made in a small town near the border"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (9, texts[5]), (7, texts[2]), (3, texts[4]), (None, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept_id", F.lit("x")).withColumn("row", F.lit("y"))
    docs = docs.toDF("doc_id", "text", "DOC_ID", "row")
    for similar in (None, 0.8):
        got = simhash_dedup.near_dedup(docs, 3, similar)
        assert got.columns == docs.columns
        assert sorted(((r[0], r[1]) for r in got.collect()), key=str) == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (3, texts[4]), (9, texts[5])], key=str)
        assert simhash_dedup.near_dedup(empty, 3, similar).count() == 0
        left = simhash_dedup.near_dedup(edge, 3, similar)
        assert left.columns == edge.columns and left.count() == len({r.fp for r in simhash_dedup.near_groups(edge).collect()})


def test_names_do_not_rest_on_digests(spark, monkeypatch):
    """Where all blocks share a digest, the blocks themselves are ranked."""
    texts = [f"text {i % 7} " * (1 + i % 3) for i in range(60)] + ["x" * 9000, "x" * 9000, "x" * 8999 + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "_digest", lambda keys: F.lit(5).cast("long"))
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {i: max(j for j, u in enumerate(texts) if u == t) for i, t in enumerate(texts)}


def test_lines(spark, tiny):
    rng = random.Random(4)
    line = "the members of the committee agreed on a plan for the coming year and published all of the minutes of their meetings online"
    texts = [f"{line}\n\n{line.upper()}!\nother words stand here in this line {i}" for i in range(3)]
    for i in range(40):
        words = line.split()
        words[rng.randrange(len(words))] += rng.choice(["s", "n", ""])
        texts.append(" ".join(words) + "\nshort\n" + " ".join(rng.choices(words, k=12)))
    texts += [None, "", "...\n***\n---", "by " * 30, "by " * 31, "by " * 60]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = [r.text for r in line_dedup.line_dedup(docs).orderBy("doc_id").collect()]
    assert got == brute_lines(texts)
    assert sum(line in (t or "") for t in got) == 1


def test_lines_of_real_documents(spark, tiny):
    rows = sorted(tiny.where("n_chars < 1500").collect(), key=lambda r: r.doc_id)[:60]
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string").coalesce(1)
    got = [r.text for r in line_dedup.line_dedup(docs).orderBy("doc_id").collect()]
    assert got == brute_lines([r.text for r in rows])


def test_lines_at_the_edge(edge, empty):
    got = line_dedup.line_dedup(edge)
    assert got.columns == [*edge.columns, "lines_", "kept_"] and got.count() == 11 and "clash kept" in {r["kept"] for r in got.collect()}
    i, j = got.columns.index("doc_id"), got.columns.index("text")
    rows = sorted(((r[i] or -1, r[j], r["lines_"], r["kept_"]) for r in got.collect()), key=lambda r: (r[0], r[3]))
    by = {}
    for d, t, n, k in rows:
        by.setdefault(d, []).append((t, n, k))
    assert sorted(x[2] for x in by[1] + by[2]) == [0, 1] and by[3] == [("", 0, 0)] and by[4] == [(None, 0, 0)]
    assert [x[1:] for x in by[7]] == [(3, 0), (3, 2)] and by[7][1][0] == "Erste Zeile.\nZweite Zeile." and by[6] == [(" \n \t\n", 0, 0)]
    assert line_dedup.line_dedup(empty).count() == 0
    left = line_dedup.without_repeats(edge)
    assert left.columns == edge.columns and left.count() == 9
    assert line_dedup.without_repeats(empty).count() == 0


def edited(words, n, rng):
    """``words`` with a letter more in each of ``n`` of them, far from each other."""
    words, first = list(words), rng.randrange(len(words))
    for k in range(n):
        at = (first + k * len(words) // n) % len(words)
        words[at] += "q"
    return " ".join(words)


def test_recall_of_edited_lines(spark, tiny):
    """Recall by edit similarity alone: of lines with letters added to words, nine of ten and more do not stay."""
    rng = random.Random(9)
    words = sorted({w for r in tiny.collect() for w in re.sub(r"[\W_]+", " ", (r.text or "").lower()).split() if len(w) > 2})
    lines = [(n, [rng.choice(words) for _ in range(n)]) for n in (2, 3, 5, 8, 10, 20, 55, 200) for _ in range(40)]
    texts, of = [], []
    for n, line in lines:
        for k in (0, 1, 2, 3):
            if k == 0 or (n >= 5 * k):
                texts.append(edited(line, k, rng)), of.append((n, k))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    left = {r.doc_id for r in line_dedup.line_dedup(docs).where("kept > 0").collect()}
    for n, k in sorted(set(of)):
        ids = [i for i, x in enumerate(of) if x == (n, k)]
        if k:
            assert sum(i not in left for i in ids) >= 0.9 * len(ids), (n, k)
        else:
            assert sum(i in left for i in ids) >= 0.9 * len(ids), n


def test_edits_of_two_letters_in_short_lines(spark):
    texts = ["chapter twelve", "chapter twelwe", "esnden", "esndeen", "esdn", "日本語のテキストをたくさん書いた長い行です", "日本語のテキストをたくさん書いた短い行です"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [r.doc_id for r in line_dedup.line_dedup(docs).where("kept > 0").orderBy("doc_id").collect()] == [0, 2, 4, 5]


def test_hot_and_long_lines(spark):
    """One line in a third of all rows, and lines of thousands of words with few of them changed or moved."""
    rng = random.Random(3)
    long = [f"w{rng.randrange(5000)}" for _ in range(6000)]
    other = [f"w{rng.randrange(5000)}" for _ in range(6000)]
    texts = ["the same line again and again"] * 2000 + [" ".join(long), edited(long, 30, rng), " ".join(long[:3000] + ["new", "words"] + long[3000:]), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.line_dedup(docs).where("kept > 0").collect()} == {0, 2000, 2003}
