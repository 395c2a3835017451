"""Conversation repair, repeated word sequences and whitening against brute force, with every awkward case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from gearledger.llm import automata, conversations, whitening

from .conftest import frame, words

SPACE = " \t\n\x0b\x0c\r"

# --- conversations

TALK = "conv_id bigint, turn bigint, role string, text string, fault string, step int, place bigint"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 9) for r in rows], TALK)


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """Cheapest edits of one conversation's (turn, role, text) by keeping every audit of least cost per shape so far."""
    rows = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(SPACE)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
    made = lambda shape: "a" if shape.endswith("u") else "u"
    follows = lambda shape, i: (i == "s" and shape == "") or (i == "u" and shape in ("", "s", "a")) or (i == "a" and shape == "u")

    def closed(best):
        for _ in range(4):
            for shape, (cost, audit, lines) in list(best.items()):
                i = made(shape)
                new = (cost + 3, audit + "I", (*lines, {"u": "user", "a": "assistant"}[i] + ":"))
                if i not in best or new < best[i]:
                    best[i] = new
        return best

    best = closed({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        later = {}

        def offer(shape, value):
            if shape not in later or value < later[shape]:
                later[shape] = value

        extra = 3 if fault == "truncated" else 0
        for shape, (cost, audit, lines) in best.items():
            offer(shape, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            if follows(shape, role[:1]):
                offer(role[:1], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
            i = made(shape)
            offer(i, (cost + extra + 3, audit + "R", (*lines, {"u": "user", "a": "assistant"}[i] + ":" + text)))
        best = closed(later)
    cost, audit, lines = min(v for shape, v in best.items() if shape in ("", "a"))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    n = Counter(faults)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def some_talk():
    pick = random.Random(5)
    texts = ["Yes.", "No!", "half a", "", " \t", "Why?", "Yes. \n", "and so", "…", "ok?"]
    rows = []
    for conv in range(120):
        for _ in range(pick.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            role = pick.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "unit", None])
            rows.append((conv, pick.choice([None, *range(7)]), role, pick.choice([*texts, None])))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hello."), (None, None, None, None), (2**60 + 1, 3, "user", "Far."), (2**60 + 2, 4, "user", "Far.")]
    rows += [(500, 1, "user", "x" * 100_000 + "."), (500, 2, "assistant", "y" * 100_000)]
    rows += [(600, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(900)]
    return rows


def test_repair_equals_brute_force(spark):
    rows = some_talk()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # conversations span batches
    try:
        table = talk(spark, rows)
        got = {r.conv_id: tuple(r)[2:] for r in conversations.audited(table, conversations.damaged(table)).select(
            "conv_id", "rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    left = defaultdict(list)
    for conv, *rest in brute_damage(rows):
        left[conv].append(tuple(rest))
    want = {c: brute_repair(left[c]) if left[c] else (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows}}
    assert got == want
    assert any(v[6] == "" for v in got.values()) and any("I" in v[6] for v in got.values())


def test_repaired_rows_are_wellformed(spark):
    edits = conversations.repair(talk(spark, some_talk())).collect()
    shape = defaultdict(list)
    for r in edits:
        if r.edit != "D":
            shape[r.conv_id].append((r.place, r.role[0]))
    assert all(re.fullmatch(r"s?(ua)+", "".join(i for _, i in sorted(v))) for v in shape.values())
    assert sum(r.opens for r in edits) == sum(r.closes for r in edits) == len({r.conv_id for r in edits})


def test_repair_shuffles_once(spark):
    plan = conversations.repair(talk(spark, [(1, 1, "user", "Hi.")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_repair_of_no_rows(spark):
    empty = talk(spark, [])
    assert conversations.audited(empty, conversations.damaged(empty)).count() == 0


# --- repeated word sequences


def brute_repeats(texts, length):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i:i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - length + 1) if count[tuple(w[i:i + length])] > 1 for j in range(i, i + length)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def removed(docs, **options):
    rows = automata.remove_repeats(docs, **options).collect()
    return Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), r.kept) for r in rows)


@pytest.mark.parametrize("crowd", [1024, 1])
def test_repeats_equal_brute_force(spark, cases, crowd):
    pick = random.Random(8)
    common = words(34, 50).split()
    rows = [(r[0], r[1]) for r in cases]
    # A phrase one word too short to count, in ever new surroundings; the same with one more word, twice.
    rows += [(100 + i, " ".join([words(9, 300 + i), *common, words(9, 400 + i)])) for i in range(30)]
    rows += [(200 + i, " ".join([words(9, 500 + i), *common, "same", words(9, 600 + i)])) for i in range(2)]
    rows += [(300 + i, " ".join(pick.choice("ab") for _ in range(200))) for i in range(6)]
    rows += [(None, words(80, 700) + "\n" + words(40, 701)), (None, words(80, 700)), (400, "a\tb\x0bc " * 30), (2**60 + 1, words(70, 700))]
    want = Counter((i, *b) for (i, _), b in zip(rows, brute_repeats([t for _, t in rows], 35), strict=True))
    assert removed(frame(spark, rows), crowd=crowd, shard_words=500) == want


def test_repeats_of_other_lengths(spark):
    pick = random.Random(9)
    rows = [(i, " ".join(pick.choice("abcd") for _ in range(40))) for i in range(20)]
    for length, gram in [(1, 1), (5, 2), (7, 7)]:
        want = Counter((i, *b) for (i, _), b in zip(rows, brute_repeats([t for _, t in rows], length), strict=True))
        assert removed(frame(spark, rows), length=length, gram=gram, shard_words=50) == want


def test_repeats_of_no_rows(spark):
    assert automata.remove_repeats(frame(spark, [])).count() == 0
    assert removed(frame(spark, [(1, None), (2, "")])) == Counter([(1, 0, 0, ""), (2, 0, 0, "")])


def test_long_texts_are_read_in_pieces():
    known = automata.Ids()
    text = words(3000, 11)
    whole = automata.word_ids(text.encode(), known)
    import pandas as pd

    cut = list(automata._grouped(pd.DataFrame({"text": [text]}), 35, known, size=500))
    starts = [b + i for ids, bounds, _, before in cut for a, z, b in zip(bounds, bounds[1:], before) for i in range(z - a - 34)]
    assert starts == list(range(3000 - 34))
    for ids, bounds, _, before in cut:
        for a, z, b in zip(bounds, bounds[1:], before):
            assert (ids[a:z] == whole[b:b + z - a]).all()


# --- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id bigint, embedding array<float>, n int, block int, cells int")


def brute_white(rows, k=8):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((n * x - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return centred @ axes / np.sqrt(values), values, [int(((n * r - sums) ** 2).sum()) for r in x]


@pytest.mark.parametrize("dim", [5, 64, 120])
def test_whitening_equals_brute_force(spark, dim):
    pick = np.random.default_rng(dim)
    shape = pick.standard_normal((dim, dim)) * np.linspace(1, 3, dim)
    rows = [(i, [float(c) for c in v @ shape / dim]) for i, v in enumerate(pick.standard_normal((400, dim)))]
    good = rows + [(7, rows[7][1]), (None, rows[8][1]), (2**60 + 1, rows[9][1])]
    bad = [(900, None), (901, []), (902, [None] * dim), (903, [float("nan")] * dim), (904, [float("inf")] + [0.0] * (dim - 1)), (905, [1.0] * (dim + 1))]
    rows_out = whitening.whiten(vectors(spark, good + bad), block_cells=40 * dim).withColumn("id", F.coalesce("vec_id", F.lit(-1)))
    got = rows_out.drop("vec_id").withColumnRenamed("id", "vec_id").toPandas()
    white, values, deviation = brute_white(good)
    k = min(8, dim)
    assert len(got) == len(good) * k and set(got["n"]) == {len(good)}
    sign = np.ones(k)
    for c in range(1, k + 1):
        part = got[got["component"] == c]
        one = part[part["vec_id"] == 3]["whitened"].iloc[0]
        sign[c - 1] = np.sign(one) * np.sign(white[3, c - 1])
        assert abs(part["explained"].iloc[0] - values[c - 1] / brute_white(good, dim)[1].sum()) < 1e-12
    want = sorted((-1 if i is None else i, c + 1, d, round(float(w[c] * sign[c]), 8) + 0.0) for (i, _), w, d in zip(good, white, deviation, strict=True) for c in range(k))
    have = sorted((r.vec_id, r.component, int(r.deviation), round(r.whitened, 8) + 0.0) for r in got.itertuples())
    assert [h[:3] for h in have] == [w[:3] for w in want]
    assert np.allclose([h[3] for h in have], [w[3] for w in want], atol=1e-7)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).select("component").distinct().count() == 1
    far = whitening.whiten(vectors(spark, [(1, [1e30, 2.0]), (2, [-1e30, 2.0]), (3, [0.0, 1.0])])).toPandas()
    assert far["deviation"].isna().any() and np.isfinite(far["whitened"]).all()


def test_whitening_is_certified(spark):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.random.default_rng(1).standard_normal((300, 70)))]
    blocks = whitening._blocks(vectors(spark, rows), "vec_id", "embedding", 70, 1024, 50)
    passes = whitening.Passes(blocks.cache(), 70, 8)
    passes.measure()
    axes = whitening.principal_axes(passes, 8, guard=8)
    assert (axes.residuals <= 1e-12 * axes.values[0]).all() and axes.passes > 10
    assert np.abs(axes.vectors.T @ axes.vectors - np.eye(8)).max() < 1e-12
    with pytest.raises(RuntimeError):
        whitening.principal_axes(passes, 8, guard=2, max_rounds=1)

