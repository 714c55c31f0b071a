"""Periodic runs, toxic spans and conversation repair against brute force, on odd rows and on empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import periodic, pii, repair, toxicity

WHITE = " \t\n\x0b\x0c\r"


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] == w[i + q]:
                j = i
                while j + q < len(w) and w[j] == w[j + q]:
                    j += 1
                if j + q - i >= max(24, 3 * q):
                    found.setdefault((i, j + q - i), q)
                i = j
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(rng):
    n, a = rng.randint(0, 220), rng.choice([1, 2, 2, 3, 6])
    w = [rng.randrange(a) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        if n > 30:
            p = rng.randint(1, min(40, n // 3))
            size = min(n, p * rng.randint(2, 6) + rng.randint(0, 5))
            s = rng.randint(0, n - size)
            for i in range(s + p, s + size):
                w[i] = w[i - p]
    if n and rng.random() < 0.3:
        w[rng.randrange(n)] = 9
    return w


def test_runs_match_brute_force_however_words_are_appended():
    rng = random.Random(8)
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 1500:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for w in [random_words(rng) for _ in range(600)] + [[ord(c) for c in fibonacci[-1]]]:
        want = brute_runs(w)
        assert periodic.runs_of(w) == want
        catchers, k = periodic.SquareCatchers(), 0
        while k < len(w):
            m = rng.choice([1, 2, 3, 7, 20, 50])
            catchers._append(np.array(w[k : k + m], np.int64))
            k += m
        assert catchers.runs() == want


def test_runs_of_long_repetitive_texts():
    assert periodic.runs_of(["x"] * 300_000) == [(0, 300_000, 1)]
    line = [str(i) for i in range(5000)]
    assert periodic.runs_of(line * 4) == [(0, 20_000, 5000)]
    assert periodic.runs_of(line * 2) == []


def test_periodic_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(map(str, random_words(rng))) for _ in range(150)] + [None, "", " \n", "é x  y\x0bz " * 9, "a b " * 3000]
    ids = [*range(-20, len(texts) - 23), None, 3, 3]
    rows = list(zip(ids, texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple("" if x is None else str(x) for x in r) for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect())
    want = []
    for doc_id, text in rows:
        w = (text or "").encode().split()
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs, best, gone = brute_runs(w), None, set()
        for s, n, q in runs:
            gone |= set(range(s + q, s + n))
            if best is None or Fraction(n, q) > Fraction(best[1], best[2]):
                best = (s, n, q)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        row = (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        want.append(tuple("" if x is None else str(x) for x in row))
    assert got == sorted(want)
    assert sum(r[1] != "0" for r in want) > 50


def test_chain_marginals_match_all_taggings():
    rng = np.random.default_rng(4)
    m = {"T": rng.normal(size=(2, 2)), "S": rng.normal(size=2)}
    sizes = [3, 1, 7, 2, 8]
    scores = [rng.normal(size=n) * 2 for n in sizes]
    first = np.zeros(sum(sizes), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    for block in (2, 3, 64):
        got = np.split(toxicity.chain_marginals(np.concatenate(scores), first, m, block), np.cumsum(sizes)[:-1])
        for e, p in zip(scores, got):
            total, one = 0.0, np.zeros(len(e))
            for tags in itertools.product((0, 1), repeat=len(e)):
                weight = np.exp(m["S"][tags[0]] + sum(m["T"][a, b] for a, b in zip(tags, tags[1:])) + sum(x for x, y in zip(e, tags) if y))
                total, one = total + weight, one + weight * np.array(tags)
            assert np.allclose(p, one / total)


def test_tagger_gradient_is_that_of_the_likelihood():
    """The expected counts that training follows, against differences of the logarithm of the sum over all taggings."""
    rng = np.random.default_rng(5)
    e, inside = rng.normal(size=(4, 2)), np.array([[1, 1], [1, 1], [1, 1], [1, 0]], bool)
    m = {"T": rng.normal(size=(2, 2)), "S": rng.normal(size=2)}

    def log_z(e, t):
        out = 0.0
        for i in range(2):
            n = int(inside[:, i].sum())
            out += np.log(sum(np.exp(m["S"][y[0]] + sum(t[a, b] for a, b in zip(y, y[1:])) + sum(e[k, i] for k in range(n) if y[k])) for y in itertools.product((0, 1), repeat=n)))
        return out

    single, pair = toxicity._windows(e, inside, m)
    for k, i in zip(*np.nonzero(inside)):
        d = np.zeros_like(e)
        d[k, i] = 1e-5
        assert abs((log_z(e + d, m["T"]) - log_z(e - d, m["T"])) / 2e-5 - single[k, i]) < 1e-6
    for a, b in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[a, b] = 1e-5
        assert abs((log_z(e, m["T"] + d) - log_z(e, m["T"] - d)) / 2e-5 - pair[a, b]) < 1e-6


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rng = random.Random(31)
    plain, foul = [f"w{k}" for k in range(300)], [stem + end for stem in ("vile", "grob") for end in "in xo ba zi ra mu te lo ki sa".split()]
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice(plain) for _ in range(rng.choice([20, 60, 200]))]
        y = int(i % 4 == 0)
        if y:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(foul))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, y))
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_toxic_spans_and_scores(spark, toxic_tables):
    docs, labels = toxic_tables
    model = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    held = {r["doc_id"]: r for r in toxicity.tag_toxic(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert len(held) > 80
    assert sum((r["score"] >= 0.5) == (i % 4 == 0) for i, r in held.items()) >= 0.97 * len(held)
    spans = [(texts[i][s["start"] : s["end"]], i) for i, r in held.items() for s in r["spans"]]
    assert len(spans) > 40 and all(re.fullmatch(r"((vile|grob)\w+\s?)+", t) for t, _ in spans)
    # a word never seen, by its beginning
    p = toxicity.Tagger(model).marginals(["w1 w2 viledu w3 w4 plaudu w5"])[0][0]
    assert p[2] > 50 * p[5]
    # offsets are in code points
    r = toxicity.tag_toxic(spark.createDataFrame([(1, "\U0001f600 w2 vilein grobba w4")], "doc_id long, text string"), model).collect()[0]
    assert [(s["start"], s["end"]) for s in r["spans"]] == [(5, 18)] and r["score"] > 0.5


def test_toxicity_of_odd_rows(spark, toxic_tables):
    docs, labels = toxic_tables
    odd = spark.createDataFrame([(None, "vilein"), (None, None), (5, ""), (5, " \n"), (6, "w1 " * 50_000), (7, "x" * 200_000), (8, "\U0001f600 ¡!")], "doc_id long, text string").withColumns({"score": F.lit("a"), "spans": F.lit(1), "toxic": F.lit(0)})
    again = labels.union(labels).union(spark.createDataFrame([(None, 1, 1), (3, 1, None)], labels.schema))
    model = toxicity.fit(docs.union(docs.limit(9)), again)
    got = toxicity.tag_toxic(odd, model).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["n_words"] == 0}) == 1
    assert toxicity.tag_toxic(odd.filter("doc_id < 0"), model).count() == 0
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None and toxicity.fit(docs.filter("doc_id < 0"), labels) is None
    assert {r["score"] for r in toxicity.tag_toxic(odd, None).collect()} == {0.5}


# conversation repair


def step(place, c):
    """Where a role's initial leads: 0 start, 1 after s, 2 after u, 3 after a."""
    if c == "s":
        return 1 if place == 0 else None
    if c == "u":
        return None if place == 2 else 2
    return 3 if c == "a" and place == 2 else None


def brute_repair(rows):
    """rows (turn, role, text) in order: every cheapest way forward, kept by place with its letters and lines."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "none")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    def offer(best, place, made):
        if place is not None and (place not in best or made[:2] < best[place][:2]):
            best[place] = made

    def inserted(best):
        for _ in range(4):
            for p, (c, letters, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    offer(best, step(p, role[0]), (c + 2, letters + "I", (*lines, f"{role}:")))
        return best

    best = inserted({0: (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for p, (c, letters, lines) in best.items():
            offer(new, p, (c + 3, letters + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = c + (fault == "truncated")
                offer(new, step(p, role[:1] or "-"), (more, letters + "K", (*lines, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    offer(new, step(p, r[0]), (more + 2, letters + "R", (*lines, f"{r}:{text}")))
        best = inserted(new)
    cost, letters, lines = min((best[p] for p in (0, 3) if p in best), key=lambda x: x[:2])
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("most", [1, 3, 256])
def test_repair_matches_brute_force(spark, most):
    rng = random.Random(most)
    rows = []
    for conv in [None, *range(-4, 40)]:
        for _ in range(rng.choice([1, 1, 2, 5, 9, 30])):
            turn = rng.choice([None, *range(12)]) if rng.random() < 0.9 else rng.randrange(10**6)
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", "u", None]), rng.choice(["a.", "b", "", " \n", "c!  ", "d?", None, "é", "ok.", "x.y"])))
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("z") for c in ("key", "known", "at", "digest", "cost", "what", "idx")})
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair_conversations(d, repair.damage(d), most).collect()}
    assert got == {conv: brute_repair(damaged([r for r in rows if r[0] == conv])) for conv in {r[0] for r in rows}}
    assert repair.repair_conversations(d.filter("turn < 0"), repair.damage(d.filter("turn < 0")), most).count() == 0


def test_repair_of_a_long_conversation_in_many_chunks(spark):
    """Rows that must all go keep the costs of a chunk apart, so its guess is mended again and again."""
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant"]), rng.choice(["", "", "", f"t{t}."])) for t in range(900)]
    rows += [(2, t, "user", "") for t in range(60)] + [(2, 60, "assistant", "end.")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit(1).cast("long"))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair_conversations(d, d, 8).collect()}
    assert got == {c: brute_repair([r[1:] for r in rows if r[0] == c]) for c in (1, 2)}


def test_cheapest_edits_of_small_conversations():
    """Letters and costs of all short conversations against every way to edit them."""
    for roles in itertools.product("sua-", repeat=3):
        codes = bytes(repair.code_of("sua-".index(c), False, False) for c in roles)
        edits, place = repair.trace(codes, repair.ENDING, repair.START, True)
        want = brute_repair([(i, {"s": "system", "u": "user", "a": "assistant", "-": "tool"}[c], f"{i}.") for i, c in enumerate(roles)])
        assert "".join(e for e, _ in edits) == want[6] and place in (repair.START, repair.ASSISTANT)
        assert repair.backward(codes, repair.ENDING)[repair.START] == want[5]


# personal data in long texts


def test_spans_by_neighbours_match_all_pairs(spark):
    rng = random.Random(14)
    rows = []
    for i in range(300):
        spans = lambda n, most: sorted({(a, a + rng.randrange(1, most)) for a in (rng.randrange(200) for _ in range(rng.randrange(n)))})
        rows.append((i, spans(12, 30), spans(9, 30)))
    kind = "array<struct<start:int,end:int>>"
    d = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}")
    got = d.select("i", pii.apart(F.col("a"), F.col("b")).alias("free"), pii.outermost(F.col("a")).alias("outer"), pii.running(F.col("a"), F.lit(0), lambda x, s: x + s["start"], "int").alias("sums")).collect()
    plain = lambda spans: [(s["start"], s["end"]) for s in spans]
    for r in got:
        _, a, b = rows[r["i"]]
        assert plain(r["free"]) == [s for s in a if not any(o[0] < s[1] and o[1] > s[0] for o in b)]
        assert plain(r["outer"]) == [s for s in a if not any(o != s and o[0] <= s[0] and o[1] >= s[1] for o in a)]
        assert r["sums"] == list(itertools.accumulate(s[0] for s in a))
    long = spark.createDataFrame([([(k, k + 1) for k in range(1000)],)], f"a {kind}")
    assert long.select(pii.running(F.col("a"), F.lit(0), lambda x, s: x + s["start"], "int").alias("s")).first()["s"] == list(itertools.accumulate(range(1000)))


def test_masks_of_long_texts(spark):
    rng, rows = random.Random(16), []
    for i in range(40):
        text = "".join(rng.choice("abé\U0001f600 \n") for _ in range(rng.choice([0, 5, 4095, 4096, 4097, 13_000])))
        spans = sorted((a, min(len(text), a + rng.choice([1, 7, 5000]))) for a in (rng.randrange(len(text)) for _ in range(rng.randrange(8)))) if text else []
        rows.append((i, text, [("k", a, b) for a, b in spans]))
    d = spark.createDataFrame(rows, "i int, text string, spans array<struct<kind:string,start:int,end:int>>")
    for r in d.select("i", pii.masked(F.col("text"), F.col("spans")).alias("m")).collect():
        _, text, spans = rows[r["i"]]
        out, at = "", 0
        for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += text[at:a] + "[k]"
            at = max(at, b)
        assert r["m"] == out + text[at:]


def test_personal_data_of_a_text_with_very_many_spans(spark):
    import time

    text = " ".join(f"the password: Xk{i:06}abcdefghij{i * 7:06} ok, a{i}@b.cc" for i in range(4000))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.find_pii(d.withColumn("text", F.substring("text", 1, 2000))).collect()
    start = time.time()
    spans = pii.find_pii(d).collect()[0]["spans"]
    assert len(spans) == 8000 and time.time() - start < 60
    assert {text[s["start"] : s["end"]] for s in spans} == {w for i in range(4000) for w in (f"Xk{i:06}abcdefghij{i * 7:06}", f"a{i}@b.cc")}
