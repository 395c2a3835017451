"""Each operator on nulls, empty and long texts, ties, repeated rows and empty tables, against brute force."""

import hashlib
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from gearledger.llm import common, components, language, merkle, mixing, packing, secrets, simhash, substrings, tokencount, topk, toxicity

from gearledger.session import Scratch

from .conftest import frame, words

W = r"[^\x20\x09-\x0D]+"


# --- top-k


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, rank int")


def test_top_k_equals_brute_force(spark):
    import random

    pick = random.Random(3)
    rows = [(i, [pick.uniform(-1, 1) for _ in range(6)], 0, 0) for i in range(160)]
    rows += [(i, [0.5] * 6, 0, 0) for i in range(160, 190)]  # ties
    rows += [(200, None, 0, 0), (201, [], 0, 0), (202, [None] * 6, 0, 0), (203, [float("nan")] * 6, 0, 0), (204, [float("inf")] * 6, 0, 0),
             (None, [1.0] * 6, 0, 0), (210, [1.0, 2.0], 0, 0), (220, [2.0, 1.0], 0, 0)]
    # Repeated ids: an equal row, rows of other vectors, and many of one id.
    rows += [(50, rows[50][1], 0, 0), (60, [1.0] * 6, 0, 0), (61, [-1.0] * 6, 0, 0), (61, [0.9] * 6, 0, 0)] + [(70, [0.25] * 6, 0, 0)] * 60
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 10 == 0, k=5, shard_rows=40, block_rows=8, fan_in=2).collect()
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    cells = [(i, [int(256 * single(x) // 1) for x in v]) for i, v in [(r[0], r[1]) for r in rows] if i is not None and v and all(x is not None and abs(x) < 9 for x in v)]
    want = Counter()
    for n, (q, v) in enumerate(cells):
        if q % 10 == 0:
            others = sorted((-sum(a * b for a, b in zip(v, w)), o) for m, (o, w) in enumerate(cells) if m != n and len(w) == len(v))[:5]
            want.update((q, rank + 1, o, -score) for rank, (score, o) in enumerate(others))
    assert Counter(tuple(r) for r in got) == want
    few = topk.top_k(vectors(spark, [(0, [1.0], 0, 0), (1, [0.1], 0, 0), (1, [0.9], 0, 0)]), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 256 * 230), (0, 2, 1, 256 * 25)]
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_sends_no_matrix_to_the_driver(spark, tmp_path):
    # Files, so that the optimizer knows how little the queries are before they are dealt to all shards.
    vectors(spark, [(i, [i / 100, 1.0], 0, 0) for i in range(400)]).write.parquet(str(tmp_path / "v"))
    found = topk.top_k(spark.read.parquet(str(tmp_path / "v")), F.col("vec_id") % 50 == 0, k=2, shard_rows=20, block_rows=2)
    assert found.count() == 16
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_top_k_is_exact_beyond_doubles(spark):
    rows = [(0, [3.0e7, 1.0], 0, 0), (1, [3.0e7, 1.0], 0, 0), (2, [3.0e7, 1.00390625], 0, 0)]
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(vectors(spark, rows), F.lit(True)).collect()}
    big = 30_000_000 * 256
    assert got[0, 1] == min(big * big + 256 * 256, 2**63 - 1) or got[0, 1] == 2**63 - 1


# --- packing


def test_packing_keeps_every_id(spark, cases):
    def encoder():
        import numpy as np

        return lambda texts: [np.array([ord(c) for c in t], dtype="<u4") for t in texts]

    docs = frame(spark, cases).repartition(5, "doc_id")
    rows = packing.pack(docs, encoder, end_id=1, length=128, windows=4, fan_in=2).collect()
    import numpy as np

    sequences = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences[r.sequence_id] and len(r.ids) == 4 * r.length
        sequences[r.sequence_id] += r.length
    assert all(n == 128 or n & (n - 1) == 0 for n in sequences.values())
    got = Counter()
    for r in rows:
        for i, v in enumerate(np.frombuffer(r.ids, dtype="<u4").tolist()):
            got[r.doc_id, r.doc_tokens, r.start + i, v] += 1
    want = Counter((d, len(t or "") + 1, i, v) for d, t, *_ in cases for i, v in enumerate([*map(ord, t or ""), 1]))
    assert got == want
    assert packing.pack(frame(spark, []), encoder).count() == 0


def test_fast_encoder_gives_the_same_ids():
    import random

    import public_tokenizers as P

    slow = packing.byte_bpe(P.path("byte_bpe_50k.json"))
    fast = packing.public_byte_bpe()
    pick = random.Random(5)
    texts = ["".join(chr(pick.choice([*range(9, 14), *range(32, 127), *range(160, 0x250), *range(0x2000, 0x2030), *range(0x4E00, 0x4E20), *range(0x1F600, 0x1F610)])) for _ in range(300)) for _ in range(200)]
    texts += ["", " ", "a <|endoftext|> b", "  two  spaces\n\n", "it's we'll I'M"]
    assert [a.tolist() for a in slow(texts)] == [a.tolist() for a in fast(texts)]


# --- mixing


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_mixing_meets_targets(spark, cases):
    docs = frame(spark, cases)
    manifest = mixing.mix(docs, block_words=16, bucket_rows=4)
    rows = mixing.mixed_sizes(manifest).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((d, len(re.findall(W, t or ""))) for d, t, *_ in cases)
    sizes = Counter()
    for _, t, _, s in cases:
        sizes[s] += len(re.findall(W, t or ""))
    target = brute_targets(sizes)
    source = {(d, len(re.findall(W, t or ""))): s for d, t, _, s in cases}
    taken = Counter()
    for r in rows:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mixed_sizes(mixing.mix(docs.repartition(7), block_words=16, bucket_rows=4)).collect()), key=str)
    drawn = manifest.filter("slot is not null").select("slot", "source_rank", "block" if "block" in manifest.columns else "round").distinct()
    assert drawn.groupBy("slot").count().filter("count > 1").count() == 0
    made = mixing.mixed_documents(docs, manifest)
    assert made.columns == docs.columns
    assert made.select(F.sum(F.regexp_count("text", F.lit(W)))).first()[0] == sum(taken.values())


def test_mixing_of_nothing(spark):
    assert mixing.mixed_sizes(mixing.mix(frame(spark, []))).count() == 0
    assert [(r.taken, r.target) for r in mixing.mixed_sizes(mixing.mix(frame(spark, [(1, None), (2, " ")]))).collect()] == [(0, 0.0)] * 2


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 31, 100, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5))).collect()]
    assert sorted(got) == list(range(n))


# --- fingerprints


def test_fingerprints(spark, cases):
    rows = [c for c in cases if c[0] is not None]
    unique = list({c[0]: c for c in rows}.values())
    got = {r.doc_id: r for r in merkle.fingerprints(frame(spark, unique).repartition(3)).collect()}
    ids = sorted(got)
    text = {c[0]: c[1] or "" for c in unique}
    for i, d in enumerate(ids):
        t, n = text[d], text[ids[(i + 1) % len(ids)]]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + n[:cut]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and (got[d].near_edited == 1) == (edited == t) or cut == 0
    assert got[5].fingerprint == got[6].fingerprint and got[5].near_next == 1.0
    assert len({r.fingerprint for r in got.values()}) == len({text[d] for d in ids})
    assert 0.6 < got[1].near_edited < 0.9 and got[1].changed_sections == [0]


def test_fingerprints_over_ranges(spark, cases):
    docs = frame(spark, [(i, words(12, i)) for i in range(300)])
    pairs = {r.doc_id: r.next_text for r in merkle.in_id_order(docs, range_rows=7).collect()}
    assert all(pairs[i] == words(12, (i + 1) % 300) for i in range(300)) and len(pairs) == 300
    assert merkle.fingerprints(frame(spark, cases)).count() == len(cases)
    assert merkle.fingerprints(frame(spark, [])).count() == 0
    one = merkle.fingerprints(frame(spark, [(None, "abcd efgh")])).first()
    assert one.n_chars == 9 and one.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest()


# --- token counts


def test_token_counts_equal_the_tokenizer(spark, cases):
    import public_tokenizers as P
    from tokenizers import Tokenizer, models

    path = P.path("piece_bpe_32k.model")
    pieces = tokencount.vocabulary(path)
    whole = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0))
    got = Counter((r.doc_id, r.n_tokens) for r in tokencount.token_counts(frame(spark, cases), lambda: tokencount.vocabulary(path)).collect())
    marked = lambda t: "".join("▁" + w for w in (t or "").replace("▁", " ").split())
    assert got == Counter((d, len(whole.encode(marked(t), add_special_tokens=False).ids)) for d, t, *_ in cases)
    ties = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0)]
    small = Tokenizer(models.Unigram([("<unk>", 0.0), *ties], unk_id=0))
    counter = tokencount.Counter(ties)
    for word in ("ab", "aab", "abab", "xyab", "axxb", "", "x"):
        assert counter.text(word) == len(small.encode(marked(word)).ids), word


# --- secrets

KEY = "AKIA" + "ABCDEFGHIJKLMNOP"
PART = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"


def test_secrets(spark):
    texts = {
        1: f"id {KEY} then {PART} at https://s3.eu.amazonaws.com/x end", 2: f"only {PART} here", 3: f"😀 {KEY} " + "pad " * 300 + PART,
        4: 'password=token:abcdefgh1 Api_Key = "abcdefgh" ſecret=abcdefgh token:short', 5: "0123456789abcdef" * 3, 6: None, 7: "", 8: KEY + " " + KEY + " " + PART,
    }
    rows = [(d, t) for d, t in texts.items()] + [(8, texts[8]), (8, "other text"), (None, texts[1])]
    found = secrets.scan(frame(spark, rows)).withColumn("spans", secrets.written(F.concat("base", "linked"))).collect()
    assert len(found) == len(rows)
    base = (("assign", secrets.ASSIGN, 2, 8), ("access", secrets.ACCESS, 0, 16), ("hex", secrets.HEX, 0, 32))
    for r in found:
        text = next(t or "" for d, t in rows if d == r.doc_id and (d != 8 or (t == "other text") == (r.n_access == 0)))
        want = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(base) for m in re.finditer(p, text, re.ASCII) if len(m[g]) >= n)
        assert sorted((s["start"], s["kind"], s["end"]) for s in r.base) == want
    linked = {(r.doc_id, r.t1): {s["kind"] for s in r.linked} for r in found}
    kinds = {d: k for (d, _), k in linked.items() if k}
    assert kinds == {1: {3, 4}, 8: {3}, None: {3, 4}}  # far or lone parts are not reported
    clean = {r.doc_id: r.text for r in secrets.redacted(frame(spark, list(texts.items()))).collect()}
    assert clean[1] == "id [ACCESS] then [SECRET] at [ENDPOINT] end" and clean[2] == texts[2] and clean[6] is None
    assert secrets.scan(frame(spark, [])).count() == 0


def brute_linked(text, scope=400):
    """Links of one text by comparing all parts."""
    out = set()
    for family, (mark, identifier, secret, endpoint) in enumerate(secrets.FAMILIES):
        find = lambda p: [m.span() for m in re.finditer(p.replace("*+", "*"), text, re.ASCII)] if mark in text else []
        ids = [m.span() for m in re.finditer(secrets.ACCESS, text) if m.end() - m.start() >= 16] if identifier is None else find(identifier)
        near = lambda a, others: any(abs(a[0] - b[0]) <= scope for b in others)
        keys = [k for k in find(secret) if near(k, ids)]
        named = [i for i in ids if near(i, find(secret))]
        out |= {("secret", *k) for k in keys} | {("endpoint", *e) for e in find(endpoint) if near(e, keys) and near(e, named)}
        out |= {("identifier", *i) for i in named} if identifier is not None else set()
    return out


def test_links_equal_brute_force(spark):
    import random

    pick = random.Random(12)
    token = lambda n, of="ABCDEFGHabcdefgh0123456789": "".join(pick.choice(of) for _ in range(n))
    makers = [
        lambda: "AKIA" + token(16, "ABCDEF0123"), lambda: token(40), lambda: token(40, "0123456789abcdef"), lambda: "https://s3.eu-west-1.amazonaws.com/bucket/x",
        lambda: "https://en.wikipedia.org/wiki/Cat", lambda: f"AccountName={token(8, 'abc123')};", lambda: f"AccountKey={token(86)}==", lambda: "store.blob.core.windows.net",
        lambda: f"{token(12, '0123456789')}-{token(32, 'abc123')}.apps.googleusercontent.com", lambda: f"GOCSPX-{token(28)}", lambda: "oauth2.googleapis.com", lambda: "amazonaws.com.example.org",
    ]
    rows = []
    for i in range(120):
        parts = [pick.choice(makers)() if pick.random() < 0.4 else "word " * pick.choice([1, 5, 60, 100]) for _ in range(14)]
        rows.append((i, " ".join(parts)))
    # An identifier beside a page and a checksum says nothing.
    rows.append((500, f"{KEY} and read https://en.wikipedia.org/wiki/Cat at {'0a1b2c3d4e' * 4}"))
    found = secrets.scan(frame(spark, rows)).collect()
    texts = dict(rows)
    got = {r.doc_id: {(secrets.KINDS[s["kind"]], s["start"], s["end"]) for s in r.linked} for r in found}
    want = {d: brute_linked(t) for d, t in texts.items()}
    assert got == want and got[500] == set()
    assert {k for v in got.values() for k, _, _ in v} == {"secret", "endpoint", "identifier"}


def test_many_findings_in_a_long_text(spark):
    import time

    text = "".join(f"token=abcdefgh{i:06d} 😀 word {i:x}\n" for i in range(30_000))
    started = time.time()
    row = secrets.redacted(frame(spark, [(1, text)])).first()
    assert row.text == re.sub(r"token=abcdefgh\d{6}", "[ASSIGN]", text) and row.n_chars == len(row.text)
    assert secrets.scan(frame(spark, [(1, text)])).first().n_assign == 30_000
    assert time.time() - started < 60


def test_running_folds(spark):
    import random

    pick = random.Random(1)
    rows = [([pick.randrange(100) for _ in range(n)],) for n in (0, 1, 2, 3, 10, 17, 100, 101)]
    frame_ = spark.createDataFrame(rows, "v array<int>")
    for of, brute in ((lambda a, x: a + x, sum), (lambda a, x: F.greatest(a, x), lambda part: max([0, *part]))):
        for r in frame_.withColumn("r", secrets.running(F.col("v"), of)).collect():
            assert r.r == [brute(r.v[:i]) for i in range(len(r.v))]


@pytest.mark.parametrize("before", ["AWS_SECRET_ACCESS_KEY=", "aws_secret_access_key:", "?a=b&key=", "export KEY = ", 'KEY="'])
def test_secrets_are_assigned_without_blanks(spark, before):
    text = f"AWS_ACCESS_KEY_ID={KEY}\n{before}{PART}\nend"
    found = secrets.scan(frame(spark, [(1, text)])).first()
    at = text.index(PART)
    assert [(s["start"], s["kind"], s["end"]) for s in found.linked] == [(at, 3, at + 40)]
    assert secrets.redacted(frame(spark, [(1, text)])).first().text == text.replace(KEY, "[ACCESS]").replace(PART, "[SECRET]")


# --- simhash


def brute_groups(values: dict, near) -> dict:
    root = {i: i for i in values}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(values)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if near(values[i], values[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("crowd", [2048, 2])
def test_links_and_groups(spark, crowd):
    import random

    pick = random.Random(7)
    base = [pick.getrandbits(64) for _ in range(12)]
    values = {}
    for i in range(150):
        v = pick.choice(base)
        for _ in range(pick.choice((0, 1, 1, 2, 3, 5))):
            v ^= 1 << pick.randrange(64)
        values[i] = v
    first = {}
    for i, v in values.items():
        first.setdefault(v, i)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    distinct = spark.createDataFrame([(signed(v), i) for v, i in first.items()], "fingerprint bigint, first_doc bigint")
    number = {signed(v): i for v, i in first.items()}
    pairs = {tuple(sorted((number[r.a], number[r.b]))) for r in simhash.links(distinct, Scratch(spark), crowd=crowd).collect()}
    held = {i: v for v, i in first.items()}
    want = {(i, j) for i in held for j in held if i < j and (held[i] ^ held[j]).bit_count() <= 2}
    assert pairs == want and want
    groups = {r.node: r.component for r in components.components(spark.createDataFrame(list(pairs), "a bigint, b bigint")).collect()}
    brute = brute_groups(held, lambda a, b: (a ^ b).bit_count() <= 2)
    assert groups == {i: c for i, c in brute.items() if any(i in p for p in pairs)}


def chain():
    """Three texts: the middle one is near the others, which are not near each other."""
    import random

    pick = random.Random(4)
    now, made = words(300, 77).split(), []
    for _ in range(80):
        now[pick.randrange(len(now))] = words(1, pick.randrange(10**9))
        text = " ".join(now)
        made.append((text, simhash.majority(simhash.shingle_hashes(text, 3))))
    far = lambda a, b: (a[1] ^ b[1]).bit_count()
    return next([x[0], y[0], z[0]] for i, x in enumerate(made) for j, y in enumerate(made[i:], i) for z in made[j:] if far(x, y) <= 2 and far(y, z) <= 2 < far(x, z))


def test_simhash_of_documents(spark, cases):
    import xxhash

    # A group that hangs together by a row without an id.
    near = chain()
    docs = [(d, t) for d, t, *_ in cases] + [(900, near[0]), (None, near[1]), (901, near[2]), (None, "only null"), (None, "only null")]
    got = simhash.near_duplicates(frame(spark, docs)).collect()
    assert len(got) == len(docs)

    def brute(t):
        w = re.findall(W, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(3, len(w))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]), 42) for i in range(len(w) - k + 1)] if w else []
        return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))

    values = {n: brute(t) for n, (_, t) in enumerate(docs)}
    group = brute_groups(values, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for n, g in group.items():
        least[g] = min((d for d in (least.get(g), docs[n][0]) if d is not None), default=None)
    want = Counter((docs[n][0], f"{values[n]:016x}", least[group[n]]) for n in values)
    assert Counter((r.doc_id, f"{r.fingerprint & (1 << 64) - 1:016x}", r.component_id) for r in got) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_near_copies_leave_one(spark, cases):
    import random

    pick = random.Random(2)
    body = words(200, 50).split()
    copies = []
    for i in range(20):
        own = list(body)
        own[pick.randrange(200)] = "changed"
        copies.append((100 + i, " ".join(own)))
    others = [(200 + i, words(200, 60 + i)) for i in range(20)]
    docs = frame(spark, copies + others + cases)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert [i for i in ids if i is not None and 100 <= i < 120] == [100] and all(ids[200 + i] == 1 for i in range(20))
    assert ids[5] == 1 and ids[6] == 0 and ids[1] == 1 and ids[7] == 0 and ids[12] == 2 and ids[2] == 1 and ids[3] == 0
    assert simhash.one_of_each(frame(spark, [])).count() == 0


def test_links_meet_in_one_join(spark):
    # One join per choice made 7 copies of the widest plan, which the driver keeps while it runs.
    distinct = spark.createDataFrame([(i, i) for i in range(9)], "fingerprint bigint, first_doc bigint")
    plan = simhash.links(distinct, Scratch(spark), crowd=2)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin ", plan)) == 1


def test_components_stop_at_stars(spark, monkeypatch):
    written, real = [], Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df: written.append(df) or real(self, df))
    found = lambda edges: {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found([]) == {} and found([(3, 3), (None, 4)]) == {} and len(written) == 2
    assert found([(5, 1), (1, 7), (9, 2), (9, 2)]) == {1: 1, 5: 1, 7: 1, 2: 2, 9: 2} and len(written) == 3
    assert found([(i, i + 1) for i in range(40)]) == dict.fromkeys(range(41), 0)
    assert found([(1, 4), (2, 4)]) == dict.fromkeys((1, 2, 4), 1)


def jaccard_groups(spark, texts: dict) -> tuple[dict, dict]:
    """Groups that near_copies finds, and those of brute force, each as text number -> set of its group."""
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    top = brute_groups(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    number = {hashlib.md5(t.encode()).hexdigest(): i for i, t in texts.items()}
    found = {number[r.text_key]: r.component for r in simhash.near_copies(frame(spark, list(texts.items())), Scratch(spark)).collect()}
    same = lambda names: {i: frozenset(j for j in names if names[j] == names[i]) for i in names}
    return same({i: found.get(i, i) for i in texts}), same(top)


def test_near_copies_start_from_simhash(spark, monkeypatch):
    real, asked = simhash.links, []

    def seen(distinct, scratch, distance):
        found = scratch.cut(real(distinct, scratch, distance))
        asked.append((distinct.count(), distance, found.count()))
        return found

    monkeypatch.setattr(simhash, "links", seen)
    base = [f"w{i}" for i in range(3000)]
    texts = [" ".join(base), " ".join([*base, "end"]), " ".join(["start", *base]), " ".join(f"v{i}" for i in range(50)), "", None]
    found = {r.text_key: r.component for r in simhash.near_copies(frame(spark, list(enumerate(texts))), Scratch(spark)).collect()}
    keys = [hashlib.md5(t.encode()).hexdigest() for t in texts[:3]]
    assert found == dict.fromkeys(keys, min(keys))
    # Four texts with words; those of the first three that don't share a fingerprint are linked by it.
    assert len(asked) == 1 and 2 <= asked[0][0] <= 4 and asked[0][1] == 2 and asked[0][2] >= asked[0][0] - 2


def test_near_copies_move_few_texts_once(spark, moved, monkeypatch):
    plans, real = [], Scratch.cut

    def seen(self, df):
        plans.append((df.columns, moved(df)))
        return real(self, df)

    monkeypatch.setattr(Scratch, "cut", seen)
    base = words(300, 80).split()
    texts = {i: " ".join([*base[:200 + i], "changed", *base[201 + i:]]) for i in range(12)} | {20 + i: words(300, 90 + i) for i in range(12)}
    got, want = jaccard_groups(spark, texts)
    assert got == want and len(want[0]) == 12
    named = lambda plan, names: sum(any(c.startswith(names) for c in exchange) for exchange in plan)
    # A text to its key, a set to where it is compared and the one that it is compared with.
    assert {sum("text" in e or "first" in e for e in p) for columns, p in plans if "shingles" in columns} == {1}
    assert max(named(p, ("shingles", "held")) for _, p in plans) == 2


@pytest.mark.parametrize(("slots_each", "most_slots"), [(16, 1 << 27), (64, 1 << 27), (16, 7), (16, 1)])
def test_rows_among_others(spark, slots_each, most_slots):
    rows = spark.range(20000).withColumn("key", F.md5(F.col("id").cast("string")))
    found = simhash.among(rows, rows.filter("id % 7 = 0"), "key", slots_each, most_slots)
    ids = [r.id for r in found.collect()]
    assert found.columns == rows.columns and len(ids) == len(set(ids)) and set(ids) >= set(range(0, 20000, 7))
    # Others stay as often as a slot is taken.
    assert len(ids) < 20000 / 7 + 20000 * 2 / slots_each or most_slots < 16
    assert simhash.among(rows, rows.filter("false"), "key").count() == 0


def test_near_copies_of_a_star(spark):
    import random

    pick = random.Random(5)
    base = words(404, 70).split()
    texts = {0: " ".join(base)}
    for i in range(1, 200):
        own = list(base)
        for at in pick.sample(range(0, 400, 6), 6):
            own[at] = f"changed{i}"
        texts[i] = " ".join(own)
    got, want = jaccard_groups(spark, texts)
    assert got == want and len(want[0]) == 200

    # Without the base hardly any copy is like another.
    del texts[0]
    got, want = jaccard_groups(spark, texts)
    assert got == want and len(set(want.values())) > 100


def test_near_copies_at_the_threshold(spark):
    texts = {}
    for i in range(90):
        body = words(404, 300 + i).split()
        other = words(404, 600 + i).split()
        # 400 shingles; a changed tail of n words changes n of them.
        n = 34 + i // 3
        texts[2 * i], texts[2 * i + 1] = " ".join(body), " ".join(body[:-n] + other[-n:])
    shares = {i: (400 - (34 + i // 3)) / (400 + 34 + i // 3) for i in range(90)}
    assert min(shares.values()) < 0.75 and max(shares.values()) > 0.84
    got, want = jaccard_groups(spark, texts)
    assert got == want and len(set(want.values())) == 90 + sum(v < 0.8 for v in shares.values())


# --- language and toxicity

TRAIN = {"en": "the house and the tree that they have with this", "de": "der baum und das haus die nicht mit einer schule ist", "fr": "le chat est avec une maison que les enfants ont dans la rue"}


def test_language(spark, cases):
    rows = [(i * 3 + j, text + " " + " ".join(text.split()[i % 5:]), lang) for i in range(20) for j, (lang, text) in enumerate(TRAIN.items())]
    model = language.fit(frame(spark, rows))
    asked = [(1, "das ist der baum", None), (2, "the tree and the house", None), (3, "les enfants et le chat", None), (4, None), (5, "123 ... 😀"), (6, ""),
             (7, " ".join([TRAIN["en"]] * 16) + " " + " ".join([TRAIN["fr"]] * 10))]
    got = {r.doc_id: r for r in language.identify(frame(spark, asked), model).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["de", "en", "fr", "und", "und", "und"] and got[4].score == 0.0
    assert set(got[7].languages) == {"en", "fr"} and 0.35 < got[7].languages["fr"] < 0.6 and got[7].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(frame(spark, cases), model).count() == len(cases)
    nothing = language.fit(frame(spark, []))
    assert {r.lang_pred for r in language.identify(frame(spark, cases), nothing).collect()} == {"und"}


def test_language_learns_every_label(spark):
    import random

    def text(i: int, seed: int) -> str:
        pick = random.Random(seed)
        return " ".join("".join(chr(0x4E00 + 20 * i + pick.randrange(20)) for _ in range(4)) for _ in range(40))

    # 90 languages of two rows and ten of one row each.
    rows = [(2 * i + j, text(i, 2 * i + j), f"l{i:03}") for i in range(100) for j in range(2 if i >= 10 else 1)]
    model = language.fit(frame(spark, rows))
    assert model.languages == [f"l{i:03}" for i in range(100)]
    got = {r.doc_id: r for r in language.identify(frame(spark, [(i, text(i, 2 * i)) for i in range(100)]), model).collect()}
    assert all(got[i].lang_pred == f"l{i:03}" and got[i].score > 0.25 for i in range(100))


def test_language_samples_by_hash(spark):
    rows = [(i, text, lang) for i, (lang, text) in enumerate([*TRAIN.items()] * 40)]
    docs = frame(spark, rows + rows[:3])
    chosen = {(r.doc_id, r.lang) for r in common.sampled(docs, "lang", 5).collect()}
    few = docs.filter(F.concat_ws(" ", "doc_id", "lang").isin([f"{i} {la}" for i, la in chosen]))
    some, full = language.fit(docs, sample_rows=5), language.fit(few)
    assert some.languages == full.languages and (some.likelihood == full.likelihood).all() and (some.unseen == full.unseen).all()


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, score string")


def test_toxicity(spark, cases):
    rows = [(i, words(40, i) + (" you utter numbskull" if i % 4 == 0 else ""), int(i % 4 == 0), None) for i in range(400)]
    model = toxicity.fit(labelled(spark, rows + [(None, "x", 1, None), (900, "y", None, None)]))
    asked = [(i, words(50, 1000 + i) + (" you utter numbskulls" if i % 2 else "")) for i in range(40)] + [(50, None), (51, "")]
    got = {r.doc_id: r for r in toxicity.score(frame(spark, asked), model).collect()}
    assert all(got[i].predicted == i % 2 for i in range(40)) and got[50].score == got[51].score and 0 <= got[51].score <= 1
    assert len(model.coordinates) < 2000
    one = toxicity.fit(labelled(spark, [(1, "a", 0, None)]))
    assert {r.predicted for r in toxicity.score(frame(spark, cases), one).collect()} == {0}
    assert toxicity.score(frame(spark, []), toxicity.fit(labelled(spark, []))).count() == 0


# --- substrings


def brute_repeats(rows, n):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[p:p + n] for _, t in data for p in range(len(t) - n + 1))
    out = Counter()
    for d, t in data:
        mark = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if seen[t[p:p + n]] > 1:
                mark[p:p + n] = b"\1" * n
        out[d, bytes(x for x, m in zip(t, mark) if not m), len(re.findall(b"\1+", bytes(mark)))] += 1
    return out


@pytest.mark.parametrize("crowd", [4096, 2])
def test_substrings_equal_brute_force(spark, cases, crowd):
    import random

    pick = random.Random(9)
    passage = words(80, 70)
    rows = [(d, t) for d, t, *_ in cases]
    for i in range(25):
        a, b = sorted(pick.sample(range(len(passage)), 2))
        rows.append((300 + i, words(20, 80 + i) + passage[a:b] + words(20, 120 + i) + ("é" * 150 if i % 5 == 0 else "")))
    got = substrings.remove_repeats(frame(spark, rows).repartition(4), window=200, gram=64, batches=3, crowd=crowd).collect()
    assert Counter((r.doc_id, bytes(r.kept), len(r.removed)) for r in got) == brute_repeats(rows, 200)
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


# --- queries and the pipeline


def test_every_operator_has_a_query():
    from gearledger.llm.queries import ORACLES, QUERIES

    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"{TRAIN[la]} " + " ".join(words(30, i).split()) + f" {TRAIN[la]}", la, "abc"[i % 3]) for i, la in enumerate(list(TRAIN) * 12)]
    rows += [(100, rows[0][1], "en", "a"), (101, "12345 !!", None, "a"), (102, None, None, None), (103, rows[1][1] + " token = \"0123456789abcdef0123\"", "de", "b"), (104, "", "en", "b")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, str(tmp_path))).collect(), out.schema)
        seen.append([r.doc_id for r in docs.collect()])
        if name != "packing":
            assert docs.columns == frame(spark, []).columns
        if name == "secrets":
            assert not any("0123456789abcdef" in r.text for r in docs.collect())
    assert set(seen[0]) == {r[0] for r in rows} - {101, 102, 104}
    assert set(seen[1]) == set(range(36)) and len(seen[1]) == len(set(seen[1])) == len(seen[2])
    assert set(seen[3]) <= set(range(36))
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Where documents are cut depends on their order; the documents themselves do not.
    whole = lambda rows: Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert whole(run) == whole(docs.collect()) and sum(r.length for r in run) == sum(r.doc_tokens for r in run if r.start == 0)


def test_mixed_texts_keep_white_space(spark):
    """A cut text is made of pieces of its own, line breaks and indentation included."""
    text = "".join(f"line {i} of\n\t  text\n\n" for i in range(400))
    docs = spark.createDataFrame([(i, text + str(i), "ab"[i % 2], "k", "m", "c", "n", 0) for i in range(12)],
                                 "doc_id bigint, text string, source string, text_key string, mixed_text string, clean_text string, near_copy_key string, n_chars bigint")
    rows = mixing.mixed_documents(docs, mixing.mix(docs, weights=(5, 1), share=1.1)).collect()
    sizes = {r.doc_id: r.taken for r in mixing.mixed_sizes(mixing.mix(docs, weights=(5, 1), share=1.1)).collect()}
    assert Counter({d: n for d, n in sizes.items() if n}) == sum((Counter({r.doc_id: len(re.findall(W, r.text))}) for r in rows), Counter())
    cut = [r for r in rows if r.text != text + str(r.doc_id)]
    assert cut and all(r.n_chars == len(r.text) for r in rows)
    for r in cut:
        at = 0
        for word in re.findall(rf"{W}[^\x20\x09-\x0D]*", r.text):
            at = (text + str(r.doc_id)).index(word, at)  # in order
        assert "of\n\t  text\n\nline" in r.text and "of text" not in r.text
    assert {(r.text_key, r.mixed_text, r.clean_text, r.near_copy_key) for r in rows} == {("k", "m", "c", "n")}


def test_stages_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh12 " + words(40, 1), "k", "c", "n"), (2, words(40, 2), "k", "c", "n"), (None, words(40, 2), "k", "c", "n")],
                                 "doc_id bigint, text string, text_key string, clean_text string, near_copy_key string")
    for made in (secrets.redacted(docs), simhash.one_of_each(docs)):
        rows = made.collect()
        assert made.columns == docs.columns and {(r.text_key, r.clean_text, r.near_copy_key) for r in rows} == {("k", "c", "n")}
    assert len(rows) == 2


def test_stages_take_any_table(spark, cases):
    """All stages on an empty table, and on null ids, null and blank texts and repeated rows."""
    import corpus_pipeline
    from gearledger.session import cut_lineage

    for rows, some in (([], False), ([*cases, *[(None, words(90, 900 + i), "en", "a") for i in range(3)], *[(1000 + i, words(80, 950 + i), "en", "ab"[i % 2]) for i in range(30)]], True)):
        docs = frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            columns, docs = docs.columns, cut_lineage(stage(spark, docs, ""))
            assert name == "packing" or docs.columns == columns
        assert (docs.count() > 0) == some
