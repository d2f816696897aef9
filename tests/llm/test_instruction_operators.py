"""Vector packing, conversation repair and hard negatives, against brute force and exact round trips."""

import array
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import negatives, repairs, vectors, wordpieces

WS = " \t\n\x0b\x0c\r"
ODD = [None, "", " \n ", "a\tb  c <|endoftext|>x É́ don't\r\nI'll 12ab   z ΑΣ Σ. ​", "x" * 5000, "́ a ́b", "one two " * 40_000, "one two three", "one two three"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    of = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda t: array.array("I", of.encode(t, add_special_tokens=False).ids).tolist()


# Vector packing


def test_word_ids_are_the_tokenizers(library, monkeypatch):
    encode = wordpieces.WordEncoder(__import__("public_tokenizers").path("word_bpe_49k.json"))
    texts = [t or "" for t in ODD] + ["It's SO., x... <|ENDOFTEXT|> é.! e\u0301.! ×. ÷, ¿Qué? 5. ab12.; \u201c.\n[A].\tB. İ. ẞ. Ǆ. ﬁ. 漢字。.", "The END.", "wo\u0338rd. I\u0307. K."]
    want = [library(t) for t in texts]
    texts = [t.encode() for t in texts]
    assert [array.array("I", x).tolist() for x in encode(texts)] == want
    monkeypatch.setattr(wordpieces, "CALL", 50)
    monkeypatch.setattr(wordpieces, "REMEMBERED", 3)
    assert [array.array("I", x).tolist() for x in encode(texts)] == want


def examples(n: int, seed: int, most: int):
    r = random.Random(seed)
    for k in range(n):
        size = r.randrange(1, most)
        yield vectors.Example(k, array.array("I", range(k * 7, k * 7 + size)).tobytes(), 0, r.randrange(1, size + 1), size)


@pytest.mark.parametrize("limits,most", [((256, 8, 256), 300), ((256, 3, 90), 700), ((64, 1, 64), 40), ((7, 2, 1), 30)])
def test_sequences_hold_every_id_within_all_limits(monkeypatch, limits, most):
    monkeypatch.setattr(vectors, "WINDOW", 50)
    spans = defaultdict(list)
    for pieces in vectors.sequences(examples(400, 3, most), limits):
        tokens = sum(x.tokens for x in pieces)
        assert tokens <= limits[0] and len(pieces) <= limits[1] and sum(x.loss(x.tokens) for x in pieces) <= limits[2]
        assert tokens == limits[0] or tokens & (tokens - 1) == 0
        for x in pieces:
            spans[x.doc].append((x.start, bytes(x.ids)))
    for x in examples(400, 3, most):
        at = 0
        for start, ids in sorted(spans[x.doc]):
            assert start == at and ids
            at += len(ids) // 4
        assert b"".join(ids for _, ids in sorted(spans[x.doc])) == x.ids


def test_the_largest_dot_product_goes_in():
    """Against plain loops over examples: what goes next has the largest weighted dot product with what is left."""
    limits = (100, 5, 60)
    pool = vectors.Pool(limits)
    own = list(examples(60, 9, 70))
    for x in own:
        pool.add(x)
    demand = [sum(x.tokens for x in own) / 100, sum(x.loss(x.tokens) for x in own) / 60]
    left = [(x.tokens, x.loss(x.tokens)) for x in own]
    room, bears = 100, 60
    for x in pool.sequence():
        dot = lambda v: demand[0] * v[0] / 100 * room / 100 + demand[1] * v[1] / 60 * bears / 60
        fits = [v for v in left if v[0] <= room and v[1] <= bears]
        if not fits:
            break
        assert (x.tokens, x.loss(x.tokens)) in fits and dot((x.tokens, x.loss(x.tokens))) == pytest.approx(max(map(dot, fits)))
        left.remove((x.tokens, x.loss(x.tokens)))
        room, bears = room - x.tokens, bears - x.loss(x.tokens)


def test_vector_packing(spark, library):
    rows = [(k, t, "clash", 1) for k, t in enumerate(ODD)] + [(7, "one two three", "clash", 2), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, length int").repartition(3)
    got = vectors.pack(docs, capacity=128, ids=True).collect()
    sequences, of = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        of[r["doc"]].append((r["start"], r["ids"], r["doc_tokens"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 128
    for k, t in enumerate(ODD):
        ids = [*library(t or ""), 1]
        if k != 7:
            assert array.array("I", b"".join(x for _, x, _ in sorted(of[k]))).tolist() == ids and {n for _, _, n in of[k]} == {len(ids)}
    assert sum(len(x) for _, x, _ in of[7]) == 4 * 2 * len([*library("one two three"), 1])
    assert vectors.pack(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        vectors.pack(docs, segments=0)


def test_prompts_bear_no_loss(spark, library):
    rows = [(k, "say this " * (k % 9), "so be it " * (k % 5)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, prompt string, text string")
    got = vectors.pack(docs, prompt="prompt", capacity=64, segments=6, loss=24).collect()
    per = defaultdict(int)
    for r in got:
        before = max(1, len(library(rows[r["doc"]][1])))
        per[r["sequence_id"]] += max(0, r["start"] + r["length"] - max(r["start"], before))
    assert max(per.values()) <= 24
    assert sum(r["length"] for r in got) == sum(len(library(p)) + len(library(t)) + 1 for _, p, t in rows)


# Conversation repair

STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain(rows, entry=0):
    """Least (cost, audit) by a plain dynamic programme over the four states of the language."""

    def inserted(at):
        for _ in range(4):
            for p, (cost, audit) in list(at.items()):
                for x in "ua":
                    q = STEPS.get((p, x))
                    if q is not None:
                        at[q] = min(at.get(q, (10**9, "")), (cost + 3, audit + "I"))
        return at

    at = inserted({entry: (0, "")})
    for initial, fault in rows:
        new = {}
        for p, (cost, audit) in at.items():
            ways = [(p, cost + 4, "D")]
            if fault != "d":
                extra = 3 * (fault == "t")
                ways += [(STEPS.get((p, initial)), cost + extra, "K")] + [(STEPS.get((p, x)), cost + 3 + extra, "R") for x in "ua" if x != initial]
            for q, c, edit in ways:
                if q is not None:
                    new[q] = min(new.get(q, (10**9, "")), (c, audit + edit))
        at = inserted(new)
    return tuple(at.get(q) for q in range(4))


def test_the_chart_has_the_least_cost_and_audit():
    r = random.Random(1)
    symbols = [i + f for i in "sua-" for f in "dt."]
    for n in range(400):
        rows = tuple(r.choice(symbols) for _ in range(n % 14))
        for entry in range(4):
            assert repairs.parsed(rows, entry) == plain([(x[0], x[1]) for x in rows], entry)
        k = r.randrange(len(rows) + 1)
        table = repairs.through(*([list(repairs.parsed(own, p)) for p in range(4)] for own in (rows[:k], rows[k:])))
        assert [tuple(x) for x in table] == [repairs.parsed(rows, p) for p in range(4)]


def brute(rows):
    """conv to (gaps, blank, duplicate, truncated, illegal, cost, audit, sha) and repaired turns."""
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, " " if role is None else role, " " if text is None else text))
    out = {}
    for c, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        counts, seen, codes = Counter(), set(), []
        for _, role, text in own:
            end = text.rstrip(WS)
            fault = "b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "."
            seen.add((role, text))
            counts[fault] += 1
            codes.append((role[:1], "d" if fault in "bd" else fault))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        at = plain(codes)
        cost, audit = min(x for x in (at[0], at[3]) if x)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        repaired, rest, user = [], iter(own), True
        for edit in audit:
            role, text = (None, "") if edit == "I" else next(rest)[1:]
            if edit == "D":
                continue
            if edit in "RI":
                role = "user" if user else "assistant"
            if role[:1] in "ua":
                user = not user
            repaired.append((role, text, edit))
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b, _ in repaired).encode()).hexdigest()
        out[c] = ((gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, sha), repaired)
    return out


def talk(seed: int, convs: int, turns: int):
    """Turns are unique but for repeated rows, which are alike."""
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        n = r.randrange(turns)
        for t in sorted(r.sample(range(2 * n + 1), n)):
            row = (c, t, r.choice(["user", "assistant", "system", "tool", None, "", "Über"]), r.choice(["Ja. ", "no", "what?\n", "", None, " \t", f"a text {r.random()}.", "ü" * 3 + "!"]))
            rows += [row] * r.choice([1, 1, 1, 2, 3])
    return rows


ODD_TALK = [(None, 1, "user", "Hm."), (None, None, "system", "Be kind."), (None, 2, "assistant", "x" * 200_000 + "."), (-5, None, "user", "Alone"), (-6, 3, None, None), (-7, 4, "system", "Only."), (-8, 9, "user", "a."), (-8, 9, "user", "a."), (-8, 9, "user", "a.")]


@pytest.mark.parametrize("columns,partitions", [(512, 4), (3, 7)])
def test_repair(spark, monkeypatch, columns, partitions):
    monkeypatch.setattr(repairs, "COLUMNS", columns)
    rows = talk(5, 40, 12) + [(99, *rest) for _, *rest in talk(6, 1, 400)] + ODD_TALK
    want = brute(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, c string, k1 int").repartition(3)
        got = {r["conv"]: tuple(r)[1:] for r in repairs.reports(df).collect()}
        assert got == {c: w for c, (w, _) in want.items()}
        turns = defaultdict(list)
        for r in sorted(repairs.repaired(df).collect(), key=lambda r: r["position"]):
            assert r["position"] == len(turns[r["conv"]])
            turns[r["conv"]].append((r["role"], r["text"], r["edit"]))
        assert dict(turns) == {c: w for c, (_, w) in want.items() if w}
        assert repairs.reports(df.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_of_the_given_conversations(spark):
    sf = "/root/testdata/sf0.001"
    rows = []
    convs = set()
    for c, t, role, text in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        convs.add(c)
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        rows += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    want = {c: w for c, (w, _) in brute(rows).items()}
    got = {r["conv_id"]: tuple(r)[1:] for r in repairs.op12(spark, sf).collect()}
    assert set(got) == convs and got == {c: want.get(c, (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())) for c in convs}


# Hard negatives


def mined(rows):
    """Brute force over (id, label, vector)."""
    width = max((len(v) for _, _, v in rows), default=0)
    x = np.zeros((len(rows), width))
    for k, (_, _, v) in enumerate(rows):
        x[k, : len(v)] = v
    ids = [negatives.LAST if i is None else i for i, _, _ in rows]
    out = []
    for a, (i, label, _) in enumerate(rows):
        if i is None or i % 100:
            continue
        scores = x @ x[a]
        order = sorted(range(len(rows)), key=lambda k: (-scores[k], ids[k]))
        for p in [k for k in order if k != a and rows[k][1] == label][:5]:
            found = [k for k in order if rows[k][1] != label and 30 * scores[p] <= 100 * scores[k] <= 90 * scores[p]][:10]
            out += [(i, rows[p][0], n + 1, rows[k][0], int(scores[p]), int(scores[k])) for n, k in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("lists,slab", [(1, 8192), (25, 3), (60, 8192)])
def test_hard_negatives(spark, monkeypatch, lists, slab):
    monkeypatch.setattr(negatives, "ANCHORS", slab)
    monkeypatch.setattr(negatives, "SCORES", 64)
    r = np.random.default_rng(4)
    centres = r.integers(-40, 40, (12, 6))
    rows = [(int(k), int(r.integers(0, 3)), [float(v) for v in centres[k % 12] + r.integers(-6, 6, 6)]) for k in range(500)]
    rows += [(k, k % 2, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]) for k in range(1000, 1080)]  # copies: ties by id
    rows += [(None, 1, [5.0, 5.0]), (200, 1, [3.0]), (100, 2, [0.0] * 6), (100, 2, [0.0] * 6), (7, 5, [])]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "id long, label int, vector array<double>, list string").repartition(5)
    got = negatives.mine(df.select("id", "label", "vector"), "id % 100 = 0", lists=lists)
    assert sorted(map(tuple, got.collect()), key=repr) == mined(rows)


def test_bounds_hold_and_skip_lists(spark):
    """Every score lies within its list's bounds, and close clusters are skipped."""
    r = np.random.default_rng(8)
    centres = r.normal(0, 300, (20, 8))
    rows = [(k, k % 3, (centres[k % 20] + r.normal(0, 5, 8)).round().tolist()) for k in range(1000)]
    index = negatives.build(spark.createDataFrame(rows, "id long, label int, vector array<double>"), 20)
    placed = index.rows.toPandas()
    x = np.stack(placed["vector"])
    slab = negatives.Slab(placed["row"].to_numpy(), placed["label"].to_numpy(), x, index)
    low, high = slab.bounds(np.arange(20))
    scores = x @ x.T
    assert (scores >= low[:, placed["list"]]).all() and (scores <= high[:, placed["list"]]).all()
    fifth = np.sort(scores, axis=1)[:, [-6]]
    slab.windows(np.full((1000, 1), -np.inf), np.full((1000, 1), np.inf), fifth)
    need = slab.wanted(np.arange(20))
    assert need.mean() < 0.5
    assert (need[:, placed["list"]] | (scores < fifth)).all()


def test_rows_that_take_no_part(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [0.1 * (k % 7), -0.3, 0.01 * k], k % 4) for k in range(300)]
    bad = [(300, [nan, 1.0, 1.0], 1), (400, [inf, 1.0, 1.0], 1), (500, [None, 1.0, 1.0], 1), (600, None, 1), (700, [1.0, 1.0, 1.0], None)]
    spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(k, (label + 1) % 10 if k % 7 == 0 else label, np.floor(256 * np.float32(v).astype(float)).tolist()) for k, v, label in rows]
    assert sorted(map(tuple, negatives.op13(spark, str(tmp_path)).collect()), key=repr) == mined(whole)
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert negatives.op13(spark, f"{tmp_path}/none").count() == 0


def test_queries_keep_columns(spark):
    got = negatives.op13(spark, "/root/testdata/sf0.001")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.groupBy("anchor_id", "positive_id").agg(F.max("rank").alias("n"), F.count("*").alias("m")).where("n != m or n > 10").count() == 0
