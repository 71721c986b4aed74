"""Toxicity, quality, mixing, image copies and the pipeline."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import image_copies, images, mixing, quality, toxicity


def brute_marginals(e, trans):
    """By enumerating all state sequences of one chain."""
    total, on = 0.0, np.zeros(len(e))
    for states in itertools.product((0, 1), repeat=len(e)):
        w = np.exp(sum(x * s for x, s in zip(e, states, strict=True)) + sum(trans[2 * a + b] for a, b in zip(states, states[1:], strict=False)))
        total += w
        on += w * np.array(states)
    p = on / total
    return np.log(p / (1 - p))


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    n = np.array([3, 7, 1, 5])
    start = np.cumsum(n) - n
    e, trans = rng.normal(0, 2, n.sum()), rng.normal(0, 1, 4)
    got = toxicity.marginals(e, start, n, trans)[0]
    want = np.concatenate([brute_marginals(e[s : s + k], trans) for s, k in zip(start, n, strict=True)])
    assert np.allclose(got, want)


def test_chains_cover_every_token_once():
    ends = np.random.default_rng(1).random(1000) < 0.02
    start, n = toxicity.chains(ends, np.array([300, 0, 699, 1]))
    assert sorted(i for s, k in zip(start, n, strict=True) for i in range(s, s + k)) == list(range(1000))
    assert {0, 300, 999} <= set(start.tolist())


def test_long_chains_are_not_cut():
    """The last, much longer chains go on by themselves, with the same result."""
    rng = np.random.default_rng(3)
    n = np.array([400, 3, 1000, *[20] * 30, 1, 300])
    start = np.cumsum(n) - n
    e, trans = rng.normal(0, 2, n.sum()), rng.normal(0, 1, 4)
    got = toxicity.marginals(e, start, n, trans)
    for s, k in zip(start, n, strict=True):
        alone = toxicity.marginals(e[s : s + k], np.zeros(1, int), np.array([k]), trans)
        assert all(np.allclose(g[s : s + k], a) for g, a in zip(got, alone, strict=True))
    assert np.allclose(toxicity.marginals(e[403:412], np.zeros(1, int), np.array([9]), trans)[0], brute_marginals(e[403:412], trans))


def corpus(n=600, seed=0):
    rng = random.Random(0)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 7))) for _ in range(300)]
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text, toxic = [rng.choice(words) for _ in range(rng.randint(20, 200))], i % 5 == 0
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["vexword", "vexword!", "grumble" + rng.choice("abcdef") * 2]))
        out.append((" ".join(text), int(toxic)))
    return out


def test_field_finds_toxic_tokens():
    train, held = corpus(seed=0), corpus(300, seed=1)
    model = toxicity.fit([t for t, _ in train], [y for _, y in train])
    got = toxicity.tag([t for t, _ in held], toxicity.Memory(model))
    assert all((s >= 0.7) == bool(y) for (s, _), (_, y) in zip(got, held, strict=True))
    for (_, bad), (t, _) in zip(got, held, strict=True):
        assert all(t.split()[k].startswith(("vexword", "grumble")) for k in bad)
    assert toxicity.tag([None, "", "  "], toxicity.Memory(model)) == [(0.0, [])] * 3
    assert toxicity.fit(["a b"], [0]).weights == {}


def test_spans_and_filter(spark, edge, empty):
    model = toxicity.fit(*map(list, zip(*corpus(), strict=True)))
    docs = spark.createDataFrame([(1, "fine words  VexWord, here"), (2, "all fine"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.tagged(docs, model).collect()}
    assert [("fine words  VexWord, here"[s.start : s.end]) for s in got[1].spans] == ["VexWord,"] and got[2].spans == [] and got[3].score == 0
    assert sorted(r.doc_id for r in toxicity.clean(docs, model).collect()) == [2, 3]
    assert toxicity.tagged(edge, model).count() == toxicity.clean(edge, model).count() == 11
    assert toxicity.tagged(empty, model).count() == toxicity.clean(empty, model).count() == 0


def test_only_learnable_labels_are_learnt(spark, tiny):
    from lectern.llm.common import fold
    from lectern.llm.labelled import sample

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got, prior = sample(tiny, labels, "toxic", fold("doc_id", 3) != 1)
    ids = got["doc_id"].to_pylist()
    assert ids and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids) and sum(prior.values()) >= len(ids)



def test_a_long_text_keeps_no_other_out_of_the_sample(spark):
    """Texts of 7 MB stand for a passage, wherever they come in the order; both classes stay, within the bound."""
    from pyspark.sql import functions as F

    from lectern.llm.labelled import BYTES, LONGEST, sample

    docs = spark.createDataFrame([(i, f"word{i} text of one kind") for i in range(200)], "doc_id long, text string")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("ö"), F.repeat(F.lit("wörd "), 1_200_000))).otherwise(F.col("text")))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    got, _ = sample(docs, labels, "toxic", F.lit(True))
    assert got.num_rows == 200
    texts = got.column("text").to_pylist()
    assert max(len(t.encode()) for t in texts) <= LONGEST and sum(len(t) > LONGEST // 8 for t in texts) == 23
    assert sum(len(t.encode()) for t in texts) <= 2 * BYTES
    assert sample(docs, labels, "toxic", F.lit(True), most_bytes=10)[0].num_rows == 2


def held_out(spark, f, column, modulus, rest):
    rows = f(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r[column] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    own = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return sum(a == b for a, b in own) / len(own)


def test_toxicity_on_held_out_documents(spark):
    from lectern.llm.queries import op2_toxicity

    assert held_out(spark, op2_toxicity, "toxic", 3, 1) >= 0.93


def test_quality_on_held_out_documents(spark):
    from lectern.llm.queries import op3_quality

    assert held_out(spark, op3_quality, "quality", 5, 0) >= 0.97


def test_ranking_prefers_the_preferred():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (400, len(quality.FEATURES)))
    y = (x[:, 0] + 0.1 * rng.normal(size=400) > -1).astype(int)
    m = quality.fit(x, y, float((y == 0).mean()))
    s = m.score(x)
    assert ((s >= 0.3) == y).mean() > 0.93 and np.corrcoef(s, x[:, 0])[0, 1] > 0.5
    assert (quality.fit(x, np.ones(400, int), 0.0).score(x) > 0.99).all()


def test_ranking_is_the_least_loss_on_pairs():
    """Against plain gradient descent on the same pairs."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (120, len(quality.FEATURES)))
    y = (x[:, 0] - x[:, 3] + rng.normal(size=120) > 0).astype(int)
    m = quality.fit(x, y, 0.4, seed=5)
    z = quality.expand(x, m.middle, m.scale)
    good, bad, draw = np.flatnonzero(y == 1), np.flatnonzero(y == 0), np.random.default_rng(5)
    n = min(quality.PAIRS, 20 * len(y))
    d = z[draw.choice(good, n)] - z[draw.choice(bad, n)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + quality.RIDGE / 2 * w @ w
    w = np.zeros(d.shape[1])
    for _ in range(3000):
        w -= 0.2 * (quality.RIDGE * w - d.T @ (1 / (1 + np.exp(d @ w))) / n)
    steepest = quality.RIDGE * m.weights - d.T @ (1 / (1 + np.exp(d @ m.weights))) / n
    assert loss(m.weights) <= loss(w) + 1e-6 and abs(loss(m.weights) - loss(w)) < 5e-3 and np.abs(steepest).max() < 1e-4


def test_measures_are_those_of_a_plain_count():
    texts = ["The quick, quick BROWN fox. 42!", "a a b", "word", "ÄÖ ß?", "x" * 30 + " ok.", None, ""]
    got = quality.measure(texts, quality.Memory())
    for t, row in zip(texts, got, strict=True):
        w = (t or "").split()
        if not w:
            assert not row.any()
            continue
        f = dict(zip(quality.FEATURES, row.tolist(), strict=True))
        joined = "".join(w)
        assert f["words"] == pytest.approx(np.log1p(len(w))) and f["distinct"] == pytest.approx(len(set(w)) / len(w))
        assert f["upper"] == pytest.approx(sum(c.isupper() for c in joined) / max(1, sum(c.isalpha() for c in joined)))
        assert f["digits"] == pytest.approx(sum(c.isdigit() for c in joined) / len(joined)) and f["word_length"] == pytest.approx(len(joined) / len(w))
        assert f["repeats"] == pytest.approx(sum(a == b for a, b in itertools.pairwise(w)) / len(w)) and f["long"] == pytest.approx(sum(len(v) > 25 for v in w) / len(w))
        assert f["stops"] == pytest.approx(sum(v[-1] in ".!?" for v in w) / len(w))


def test_quality_at_the_edge(edge, empty):
    m = quality.fit(quality.measure(["good words here.", "bad%%% &&& $$$"] * 5, quality.Memory()), np.array([1, 0] * 5), 0.5)
    assert quality.scored(edge, m).count() == 11 and quality.scored(empty, m).count() == 0


def brute_targets(size, weight, share=1.5, cap=2.0):
    got, left = {s: 0.0 for s in size}, share * sum(size.values())
    open_ = set(size)
    while left > 1e-9 and open_:
        total, spare = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            got[s] += left * weight[s] / total
        for s in list(open_):
            if got[s] > cap * size[s]:
                spare += got[s] - cap * size[s]
                got[s] = cap * size[s]
                open_.discard(s)
        left = spare
    return got


def test_mixing(spark, tiny):
    rows = mixing.mix(tiny).collect()
    text = {r.doc_id: r for r in tiny.collect()}
    size = {}
    for r in rows:
        assert r.size == len(text[r.doc_id].text.encode().split()) and r.taken in (0, r.size, 2 * r.size)
        size[r.source] = size.get(r.source, 0) + r.size
    names = sorted(size)
    want = brute_targets(size, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)})
    most = {s: max(r.size for r in rows if r.source == s) for s in names}
    for s in names:
        own = [r for r in rows if r.source == s]
        assert abs(own[0].target - want[s]) < 1e-6 * max(1, want[s]) and own[0].source_size == size[s]
        assert abs(sum(r.taken for r in own) - want[s]) <= most[s]
    again = {r.row: r.taken for r in mixing.mix(tiny).collect()}
    assert again == {r.row: r.taken for r in rows}


def test_rounding_keeps_sums_and_expectations(spark):
    rows = [("s", 2000, i, i, 1 + i % 7, 0, 0.3) for i in range(2000)]
    df = spark.createDataFrame(rows, "source string, docs long, row long, doc_id long, size long, tie long, p double")
    mean = np.zeros(2000)
    for seed in range(3):
        got = {r.row: r.p for r in mixing.rounded(df, 2000, seed).collect()}
        assert len(got) == 2000 and set(got.values()) == {0.0, 1.0}
        assert abs(sum(p * (1 + i % 7) for i, p in got.items()) - 0.3 * sum(1 + i % 7 for i in range(2000))) <= 7
        mean += [got[i] for i in range(2000)]
    assert abs(mean.mean() / 3 - 0.3) < 0.03


def test_rows_of_one_id_are_spread(spark):
    """100,000 rows of one doc_id and size do not meet in one group."""
    rows = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source"))
    rows = rows.unionAll(spark.range(1000).select(F.lit(None).cast("long"), F.lit("a b"), F.lit("t")))
    got = mixing._with_ties(mixing.sizes(rows)).groupBy("source").agg(F.count_distinct("tie").alias("n")).collect()
    assert {r.source: r.n for r in got} == {"s": 100_000, "t": 1000}
    taken = {r.source: (r.taken, r.target) for r in mixing.mix(rows).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(a - b) <= 3 for a, b in taken.values())


def test_mixing_at_the_edge(edge, empty):
    rows = mixing.mix(edge).collect()
    assert len(rows) == 11 and all(r.taken == 0 for r in rows if r.size == 0) and all(r.taken <= 2 * r.size for r in rows)
    assert sorted({r.source for r in rows}, key=str) == ["None", "a", "b", "c"] or {r.source for r in rows} == {"a", "b", "c", None}
    out = mixing.mixed(edge)
    assert out.columns == edge.columns and out.count() >= 3
    assert mixing.mix(empty).count() == mixing.mixed(empty).count() == 0


def test_png_round_trip():
    x = np.random.default_rng(0).integers(0, 256, (40, 33)).astype(np.uint8)
    assert (images.decode(images.png(x)) == x).all()
    assert (images.decode(b"P5\n# c\n33 40\n255\n" + x.tobytes()) == x).all()
    for bad in (None, b"", b"\x89PNG\r\n\x1a\nrubbish", b"GIF89a", images.png(x)[:60]):
        assert images.decode(bad) is None


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    import struct

    x = np.random.default_rng(kind).integers(0, 256, (6, 9)).astype(int)
    raw = b""
    for y in range(6):
        line = []
        for i in range(9):
            a, b, c = (x[y, i - 1] if i else 0), (x[y - 1, i] if y else 0), (x[y - 1, i - 1] if y and i else 0)
            p = min((a, b, c), key=lambda v, t=a + b - c: abs(t - v))
            line.append((x[y, i] - {1: a, 2: b, 3: (a + b) // 2, 4: p}[kind]) % 256)
        raw += bytes([kind, *line])
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 6, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (images.decode(data) == x).all()


def chunk(name, data):
    import struct

    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
@pytest.mark.parametrize("laced", [0, 1])
def test_png_depths_and_interlacing(depth, laced):
    import struct

    h, w = 13, 11
    x = np.random.default_rng(depth).integers(0, 1 << min(depth, 8), (h, w))
    raw = b""
    for left, top, dx, dy in images.PASSES if laced else ((0, 0, 1, 1),):
        for row in x[top::dy, left::dx]:
            if len(row):
                bits = "".join(f"{v:0{depth}b}" if depth < 16 else f"{v:08b}10101010" for v in row)
                raw += b"\0" + bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 0, 0, 0, laced)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (images.decode(data) == x * (255 // ((1 << min(depth, 8)) - 1))).all()


def test_strips_and_neighbours_make_no_difference(monkeypatch):
    rows = lambda spots: sorted(spots.tolist())
    pictures = [picture(60, 400, 200).astype(np.float32), picture(61, 88, 200).astype(np.float32), picture(62, 128, 200).astype(np.float32)[:121], None, picture(63, 96, 160).astype(np.float32)[:90]]
    together = image_copies._spots(pictures)
    alone = [image_copies._spots([p])[0] for p in pictures]
    assert [rows(a) for a in together] == [rows(a) for a in alone] and len(alone[0]) > 50
    monkeypatch.setattr(image_copies, "STRIP", 200 * 70)
    assert rows(image_copies._spots([pictures[0]])[0]) == rows(alone[0])


def picture(seed, h=160, w=160):
    rng = np.random.default_rng(seed)
    x = np.kron(rng.integers(0, 256, (h // 8, w // 8)), np.ones((8, 8)))
    return (x + rng.integers(0, 12, (h, w))).clip(0, 255).astype(np.uint8)


def test_crops_and_edits_are_found(spark):
    a, b = picture(1), picture(2)
    edited = a.copy()
    edited[60:90, 60:90] = 0
    media = [(1, images.png(a)), (2, images.png(a[24:, 16:144])), (3, images.png(edited)), (4, images.png(b)), (5, images.png(b[:120, 24:])), (6, images.png(picture(3))), (7, None), (8, b"no image"), (9, images.png(a)), (9, None), (None, images.png(a))]
    df = spark.createDataFrame([(i, m, "clash") for i, m in media], "id long, image binary, class_id string")
    got = {r.id: r.class_id for r in image_copies.image_copies(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 1}
    assert image_copies.image_copies(df.limit(0)).count() == 0


def test_images_with_few_corners_are_found(spark):
    flat = np.full((60, 70), 90, np.uint8)
    one, dot = np.full((44, 44), 250, np.uint8), np.full((44, 44), 250, np.uint8)
    one[20:, 22:] = dot[10:12, 30:33] = 5
    edited = one.copy()
    edited[0:3, 0:3] = 240
    short = images.thumbnail("<p>one short page</p>")
    pgm = b"P5 70 60 255\n" + flat.tobytes()
    media = [(1, images.png(flat)), (2, pgm), (3, images.png(flat[:50])), (4, images.png(one)), (5, images.png(one)), (6, images.png(edited)), (7, images.png(dot)), (8, short), (9, short), (10, None), (11, b"no image"), (12, b"")]
    assert 0 < len(image_copies.describe(images.png(one))) < image_copies.LEAST_VOTES
    got = {r.id: r.class_id for r in image_copies.image_copies(spark.createDataFrame(media, "id long, image binary")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 8, 10: 10, 11: 11, 12: 12}


def spots_of(rows):
    """Rows (lo, hi, x, y, scale, turn) as an image's spots."""
    return np.array([tuple(r) for r in rows], image_copies._SPOT)


def found_of(spark, images_):
    rows = [(i, s.tobytes(), len(s), len(np.unique(s[["x", "y"]])), image_copies.sketch(s, len(s), (99, 900 + i)).tolist(), 99, 900 + i) for i, s in images_.items()]
    return spark.createDataFrame(rows, "id long, spots binary, n int, places int, entries array<long>, height int, width int")


def test_copies_whose_descriptors_are_of_many_images_link(spark):
    """Each descriptor of two copies is also in an earlier image, of 4 or of 12 that hold some each; half of the descriptors elsewhere link too."""
    for many, each in ((4, 3), (12, 3)):
        rng = np.random.default_rng(many)
        n = many * each
        bits, place = rng.integers(-(2**62), 2**62, (n, 2)).tolist(), rng.integers(20, 900, (n, 2)).tolist()
        spots = lambda ks, dx=0: spots_of([(*bits[k], place[k][0] + dx, place[k][1], 0, 0) for k in ks])  # noqa: E731, B023
        held = {**{i: spots(range(each * i, each * i + each)) for i in range(many)}, 20: spots(range(n)), 21: spots(range(n)), 22: spots(range(0, n, 2), 40)}
        got = [(r.a, r.b) for r in image_copies.links(found_of(spark, held)).collect()]
        assert {x for p in got for x in p} == {20, 21, 22} and len(set(got)) >= 2


def test_recall_of_links(spark):
    """Of images that crops, edits and other images' descriptors leave a quarter to all of their descriptors, nine of ten link; others do not."""
    rng = np.random.default_rng(8)
    common = [(*rng.integers(-(2**62), 2**62, 2).tolist(), *rng.integers(20, 900, 2).tolist(), 0, 0) for _ in range(30)]
    held, pairs = {}, {}
    for i in range(300):
        # A third of all images hold the same passage of five or so descriptors.
        own = [(*rng.integers(-(2**62), 2**62, 2).tolist(), *rng.integers(20, 900, 2).tolist(), 0, 0) for _ in range(int(rng.integers(20, 120)))]
        if i % 3 == 0:
            own += [common[k] for k in rng.choice(30, 5, replace=False)]
        part = (1.0, 0.6, 0.35)[i % 3 if i % 2 else 0]
        crop = [(lo ^ (1 << int(rng.integers(62))), hi, x - 7, y - 5, s, t) for lo, hi, x, y, s, t in (own[k] for k in rng.permutation(len(own))[: int(np.ceil(part * len(own)))])]
        held[i], held[1000 + i], pairs[i] = spots_of(own), spots_of(crop), part
    got = {(r.a, r.b) for r in image_copies.links(found_of(spark, held)).collect()}
    assert all(a - b == 1000 for a, b in got)
    for part in set(pairs.values()):
        ids = [i for i, p in pairs.items() if p == part]
        assert sum((1000 + i, i) in got for i in ids) >= 0.9 * len(ids), part


def test_votes_of_turned_scaled_and_shifted_corners():
    """Votes find a turn by any angle and halving, and do not take corners for each other that lie elsewhere."""
    rng = np.random.default_rng(5)
    base = [(*rng.integers(-(2**62), 2**62, 2).tolist(), *rng.integers(100, 500, 2).tolist(), 1, int(rng.integers(24))) for _ in range(40)]
    for angle in (0.0, 0.4, 1.7, 3.1, 5.0):
        c, s, step = np.cos(angle), np.sin(angle), round(angle * 24 / (2 * np.pi))
        moved = [(lo, hi, int(0.5 * (c * x - s * y)) + 30, int(0.5 * (s * x + c * y)) + 11, 0, (t + step) % 24) for lo, hi, x, y, _, t in base]
        assert image_copies.agree(spots_of(moved), spots_of(base)) >= 34
    other = [(lo, hi, *rng.integers(0, 5000, 2).tolist(), 1, t) for lo, hi, _, _, _, t in base]
    assert image_copies.agree(spots_of(other), spots_of(base)) < 10


def test_hot_entries_do_not_make_all_pairs(spark):
    rng = np.random.default_rng(2)
    logo = [(*rng.integers(-(2**62), 2**62, 2).tolist(), *rng.integers(20, 900, 2).tolist(), 0, 0) for _ in range(6)]
    held = {i: spots_of(logo + [(*rng.integers(-(2**62), 2**62, 2).tolist(), *rng.integers(20, 900, 2).tolist(), 0, 0) for _ in range(40)]) for i in range(400)}
    found = found_of(spark, held)
    assert image_copies.candidates(found).count() <= 4 * 400 and image_copies.links(found).count() == 0


def test_pages_have_corners(tiny, spark):
    """Of pictures of pages few have too few corners for links by votes."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    n = [len(image_copies.describe(images.thumbnail(r.html))) for r in pages]
    assert sum(x < image_copies.LEAST_VOTES for x in n) < 0.2 * len(n)


@pytest.mark.parametrize("kind", ["blur", "noise", "contrast", "turn"])
def test_edited_pictures_link(spark, kind):
    media = []
    for i in range(12):
        x = picture(40 + i, 240, 240).astype(float)
        if kind == "blur":
            y = sum(np.roll(np.roll(x, a, 0), b, 1) for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9
        elif kind == "noise":
            y = x + np.random.default_rng(i).normal(0, 4, x.shape)
        elif kind == "contrast":
            y = 40 + 0.7 * x
        else:
            y = np.rot90(x)
        media += [(i, images.png(x.astype(np.uint8))), (100 + i, images.png(y.clip(0, 255).astype(np.uint8)))]
    got = {r.id: r.class_id for r in image_copies.image_copies(spark.createDataFrame(media, "id long, image binary")).collect()}
    assert sum(got[100 + i] == i for i in range(12)) >= 11 and all(got[i] == i for i in range(12))


def test_pipeline(spark, tiny, library_ids):
    """Stage by stage against plain versions; the packing is checked by what it must keep."""
    import corpus_pipeline as c
    from tests.llm.test_dedup import brute_fingerprint
    from tests.llm.test_tokens import check_packing

    sf, docs, seen = "/root/testdata/sf0.001", tiny, {}
    for name, stage in c.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf)
        assert docs.columns == tiny.columns
        from lectern.llm.common import stored

        docs = stored(docs, "test")
        seen[name] = docs.collect()
        assert len(seen[name]) > 0.6 * before.count()
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    assert toxic <= {r.doc_id for r in seen["toxicity"]}
    lines = [x.strip().lower() for r in seen["line dedup"] for x in (r.text or "").split("\n") if any(ch.isalnum() for ch in x)]
    assert len(lines) == len(set(lines)) and all(r.n_chars == len(r.text) for r in seen["line dedup"])
    fps = [brute_fingerprint(r.text, 5) for r in seen["SimHash near-dedup"]]
    assert all(bin(a ^ b).count("1") > 3 for a, b in itertools.combinations(fps, 2))
    # Packed are the mix's rows, each as often as it takes them.
    mix = seen["mixing"]
    rows = c.packing(spark, docs, sf).collect()
    assert sum(r.length for r in rows) == sum(len(library_ids(r.text)) + 1 for r in mix)
    times = {d: sum(r.doc_id == d for r in mix) for d in {r.doc_id for r in mix}}
    count = {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        count[key] = count.get(key, 0) + 1
    assert all(n == times[k[0]] for k, n in count.items())
    ids = {r.doc_id: library_ids(r.text) for r in mix}
    # Copies of a document get ids of their own, so that each is checked as one document.
    apart, nth = [], {}
    for r in rows:
        k = nth[r.doc_id, r.piece] = nth.get((r.doc_id, r.piece), -1) + 1
        apart.append(r.__class__(*[(r.doc_id, k) if c == "doc_id" else r[c] for c in r.__fields__]))
    for r in apart:
        r.__fields__ = rows[0].__fields__
    check_packing(apart, {(d, k): ids[d] for d in ids for k in range(times[d])})


def test_pipeline_at_the_edge(spark, edge, empty):
    """Every stage takes nulls, empty tables, repeated rows and clashing names, and returns the same columns."""
    import corpus_pipeline as c
    from lectern.llm.common import stored

    for docs in (edge, empty):
        names = docs.columns
        at = stored(docs.toDF(*(f"c{i}" for i in range(len(names)))), "edge").toDF(*names)
        for _, stage in c.STAGES[:-1]:
            out = stage(spark, at, "/root/testdata/sf0.001")
            assert out.columns == names
            at = stored(out.toDF(*(f"c{i}" for i in range(len(names)))), "edge").toDF(*names)
        assert c.packing(spark, at, "").count() >= (docs is edge)


@pytest.fixture
def library_ids():
    from tokenizers import Tokenizer

    from lectern.llm.queries import vocabulary

    t = Tokenizer.from_file(vocabulary())
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_quality_learns_from_every_label(spark):
    """More labels of a class than the sample held, and a text longer than its passages: all are measured whole, and all are in a pair."""
    from pyspark.sql import functions as F

    docs = spark.range(7000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 5, F.repeat(F.lit("wörd "), 50_000)).when(F.col("id") % 70 == 0, F.concat(F.lit("##!! $$"), F.col("id"))).otherwise(F.concat(F.lit("A fair sentence of words, number "), F.col("id"), F.lit("."))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 70 != 0).cast("int").alias("quality"))
    rows = quality.measured(docs, labels, F.col("doc_id") % 7 != 1).cache()
    assert rows.count() == 6000 and abs(rows.where("doc_id = 5").first()["x"][0] - np.log1p(50_000)) < 1e-9
    pairs, n = quality._paired(rows, 100, 5900)
    assert pairs.count() == n and pairs.select("g").distinct().count() == rows.where("y = 1").select("x").distinct().count() and pairs.select("b").distinct().count() == rows.where("y = 0").select("x").distinct().count()
    model = quality.trained(docs, labels, F.col("doc_id") % 7 != 1)
    got = quality.scored(docs, model).join(labels, "doc_id").where("doc_id <> 5").agg(F.avg(((F.col("score") >= quality.CUT).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert got > 0.99


def test_quality_of_one_class_is_constant(spark, empty):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    for y, low in ((0, True), (1, False)):
        model = quality.trained(docs, docs.select("doc_id", F.lit(y).alias("quality")), F.lit(True))
        assert all((r.score <= quality.CUT + 1e-9) == low for r in quality.scored(docs, model).collect())


def test_quality_shuffles_features_not_texts(spark):
    """Texts are measured before they meet labels, once, and scores are those of the model from the same labels."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 4 == 0, "bad%%% &&& $$$ " * 5).otherwise(F.concat(F.lit("Good words stand here, "), "id")).alias("text"))
    labels, learn = docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality")), F.col("doc_id") % 5 != 0
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = quality.measured(docs, labels, learn)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.index("SortMergeJoin") < plan.index("MapInArrow")
    got = {r.doc_id: r.score for r in quality.scored_by_labels(docs, labels, learn).collect()}
    want = {r.doc_id: r.score for r in quality.scored(docs, quality.trained(docs, labels, learn)).collect()}
    assert len(got) == 400 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
