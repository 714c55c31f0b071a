"""Operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from reelspark.llm import bpe, chat_format, exact_dedup, fingerprint, licenses, lm_scoring, near_dedup, packing, pii, quality

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "the of and thing ered onst hat wher ing tion able ness dull bright quick slow red blue".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([1, 3, 6, 40, 120])) for _ in range(40)]
    near = []
    for t in base[:14]:
        w = t.split()
        if len(w) > 30:
            w[rng.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    special = [None, "", " \n\t", "Über <|endoftext|> 日本 \U0001f600 it's  \n\n x", "mail a.b@c.de +49 (30) 123-45 67 1.2.3.4 4111 1111 1111 1111", prose(rng, 6000)]
    return base + near + base[:5] + [b.upper() + " " for b in base[:3]] + special


@pytest.fixture(scope="module")
def docs(spark, texts):
    # columns whose names the operators use inside
    rows = [(i, t, "h", 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, h string, n int, cand string").repartition(3).cache()


def empty(docs):
    return docs.filter("doc_id < 0")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def sets_of(texts, n=5):
    out = {}
    for i, t in enumerate(texts):
        w = words_of(t)
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def brute_components(texts, percent):
    sets = sets_of(texts)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, texts, weak):
    """Also with a hash that collides for most texts."""
    got = by_id(exact_dedup.exact_dedup(docs, (lambda c: F.substring(F.md5(c), 1, 1)) if weak else F.md5))
    groups = collections.defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    for i, t in enumerate(norm):
        groups[t].append(i)
    assert len(got) == len(texts)
    for i, r in got.items():
        keep = min(groups[norm[i]], key=lambda k: (-len(texts[k] or ""), k))
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(groups[norm[i]]), keep == i)
        assert r["text_sha256"] == hashlib.sha256(norm[i].encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty(docs)).count() == 0


@pytest.mark.parametrize("percent,node,levels", [(85, 48, 6), (80, 48, 6), (85, 2, 2)])
def test_near_dedup(docs, texts, percent, node, levels):
    """Small nodes and few levels send the rest through blocks."""
    sets, component = brute_components(texts, percent)
    got = by_id(near_dedup.near_dedup(docs, percent, node=node, levels=levels))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), component[i], component[i] == i) for i in sets}
    assert near_dedup.near_dedup(empty(docs)).count() == 0


def test_near_dedup_large_group(spark):
    """A group of near copies larger than any node, chained so that not all are linked to its first."""
    rng = random.Random(3)
    words = prose(rng, 60).split()
    texts = []
    for k in range(150):
        w = list(words)
        w[0] = f"first{k}"
        w[-1] = f"last{k % 7}"
        texts.append(" ".join(w))
    texts += [prose(rng, 60) for _ in range(20)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, component = brute_components(texts, 85)
    got = by_id(near_dedup.near_dedup(d, 85, node=8, levels=3))
    assert [got[i]["component_id"] for i in range(len(texts))] == component


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
}


def test_pii_base(spark):
    rng = random.Random(11)
    parts = ["a@b", "@c.de", "x.y@m-n.org", "_q@r.s.t", "1.2.3.4", ".5.6.7", "256.1.1.1", "0001.2.3.255", "4111111111111111", "4111 1111-1111 1111", " ", "-", "+49 30 (123).456-7", "+1", "token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\"", "é\U0001f600", "word", "\n", "12"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)] + [None, "9" * 3000, "a" * 5000 + "@", "7 " * 4000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.find_pii(d))
    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, t or "") if ok(m[0])]
        assert [tuple(s) for s in got[i]["spans"] if s["kind"] in BASE] == want, t
    assert any(s["kind"] == "secret" for r in got.values() for s in r["spans"])
    assert pii.find_pii(d.filter("doc_id < 0")).count() == 0


def test_pii_values_after_cues(spark):
    """Values with blanks and dashes or without a digit are found and masked; words that merely follow a cue are not."""
    rng = random.Random(19)
    cued = {
        "my ssn: 123-45-6789, thanks": "123-45-6789",
        "iban: GB82 WEST 1234 5698 7654 32 The rest": "GB82 WEST 1234 5698 7654 32",
        'password = "correcthorsebattery"': "correcthorsebattery",
        "passwd: 'correct horse'": "correct horse",
        "api_key=abcdefghijkl.": "abcdefghijkl",
        "account: 12345": "12345",
        'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"': "9b0b3c6a43eb78aa99cbd7049c572391524f37a8",
    }
    free = ["the secret garden is open", "on account of rain", "a token effort", "passport control", "tokenize this: now"]
    texts = [f"{prose(rng, 20)} {t} {prose(rng, 5)}" for t in [*cued, *free]] + [prose(rng, 200) for _ in range(30)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.find_pii(d))
    for i, t in enumerate(texts):
        assert [t[s["start"] : s["end"]] for s in got[i]["spans"]] == ([list(cued.values())[i]] if i < len(cued) else []), t
    for r in pii.stage_pii(spark, d, "").collect():
        assert not any(v in r["text"] for v in cued.values())


def test_pii_stage_masks(spark):
    d = spark.createDataFrame([(1, "mail a@b.cd now", "en", "s", 15), (2, None, "en", "s", 0), (3, "plain", None, "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in pii.stage_pii(spark, d, "").collect()}
    assert got == {1: "mail [email] now", 2: None, 3: "plain"}
    assert pii.stage_pii(spark, d, "").columns == d.columns


def test_reliabilities_follow_agreement():
    """Two labelers that agree outweigh one that votes at random."""
    patterns = [((1, 1, 0, 0, 0, 0), 40), ((-1, -1, 0, 0, 0, 0), 60), ((1, 1, 1, 0, 0, 0), 20), ((-1, -1, 1, 0, 0, 0), 20)]
    _, _, post = pii.fit_reliabilities(patterns)
    assert post[1, 1, 0, 0, 0, 0] > 0.9 and post[-1, -1, 1, 0, 0, 0] < 0.2


def encoding():
    ranks = bpe.read_ranks(bpe.default_ranks())
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("common", [0, 50])
def test_bpe_round_trip(docs, texts, common):
    enc, rank_map = encoding(), bpe.RankMap(bpe.read_ranks(bpe.default_ranks()))
    rows = bpe.encode_chars(docs, rank_map, common=common).select("doc_id", bpe.ids_of(F.col("chars")).alias("ids"), bpe.packed_ids(F.col("chars")).alias("packed"), bpe.decode(F.col("chars"), rank_map).alias("back")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        want = enc.encode_ordinary(t)
        assert r["ids"] == want and bytes(r["packed"]) == struct.pack(f"<{len(want)}I", *want)
        assert bytes(r["back"]) == t.encode()


@pytest.mark.parametrize("common", [0, 50])
def test_bpe_keeps_the_byte_of_id_zero(spark, common):
    texts = ["!", "a!b !! it's done!", "!" * 40 + "\x00!", "no mark"]
    assert bpe.read_ranks(bpe.default_ranks())[b"!"] == 0
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(d, common=common).collect()}
    assert got == {i: encoding().encode_ordinary(t) for i, t in enumerate(texts)}


def test_bpe_long_words_marks_and_repeats(spark):
    """A text of 100,000 characters, words of 2,000, the characters that part entries, repeated rows and a null id."""
    enc, rng = encoding(), random.Random(31)
    long = "".join(rng.choice("abcdefgh tion") for _ in range(100_000))
    texts = [long, "x" * 2000, "9" * 2000, bpe.MARK + "a" + bpe.PART, "\x00 \x01\ufffd", "same", "same", None]
    d = spark.createDataFrame([(i if i != 6 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(d, common=100).collect()}
    assert all(got[i if i != 6 else None] == enc.encode_ordinary(t or "") for i, t in enumerate(texts))
    assert bpe.encode(d.filter("doc_id < 0")).count() == 0


def test_bpe_table_of_common_words(spark):
    """A slot's words are those of most documents, in that order, with their ids; texts whose words fill the table several times over are encoded whole."""
    word = lambda k: f"{chr(97 + k // 26)}{chr(97 + k % 26)}q"
    enc, rank_map = encoding(), bpe.RankMap(bpe.read_ranks(bpe.default_ranks()))
    texts = [" ".join(word(k) for k in range(i + 1)) for i in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known, n = bpe.common_words(d, rank_map, bpe.default_pattern(), 16)
    t = spark.range(1).select(known.alias("t")).first()["t"]
    assert n == 4 and len(t["word"]) == len(t["ids"]) == len(t["more"]) == n
    slots = {r["w"]: r["slot"] for r in spark.createDataFrame([(word(0),), *[(f" {word(k)}",) for k in range(1, 60)]], "w string").select("w", bpe._slot(F.col("w"), n).alias("slot")).collect()}
    for slot in range(n):
        more = [e.split(bpe.PART) for e in t["more"][slot].strip(bpe.MARK).split(bpe.MARK)]
        held = [(t["word"][slot], t["ids"][slot]), *map(tuple, more)]
        assert [w for w, _ in held] == [w for w, s in slots.items() if s == slot][: bpe.WAYS]
        assert all([ord(c) for c in ids] == enc.encode_ordinary(w) for w, ids in held)
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(d, common=16).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_packing(docs, texts):
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = packing.pack_documents(docs, island=20).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        place = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, place) and (k == 0 or r["length"] == 2048)
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[place : place + r["length"]]))
            place += r["length"]
        assert place == len(ids)
    total = 0
    for s in sequences.values():
        place = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place <= 2048
        total += place
    assert len(sequences) <= -(-total // 2048) + 2
    assert packing.pack_documents(empty(docs)).count() == 0


def test_packing_queries_give_added_tokens_their_ids(spark, tmp_path):
    """The query and the pipeline's stage, against the library as it is called without further settings."""
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(17)
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f" {end}\n{end}x ", "<|endoftext|", "plain", None, "word " * 3000 + end + " tail" * 2000]
    texts += ["".join(rng.choice([end, " ", "\n", "a", "日", "<|", "'s", "  "]) for _ in range(rng.randrange(12))) for _ in range(100)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert 50256 in library.encode(texts[0], add_special_tokens=False).ids
    for made in (packing.op9_best_fit_packing(spark, str(tmp_path)), packing.stage_packing(spark, d, str(tmp_path))):
        seen = collections.Counter()
        for r in made.collect():
            ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
            held = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(held)}I", *held)) and len(held) == r["length"]
            seen[r["doc_id"]] += len(held)
        assert seen == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_text_ids_match_the_library():
    enc, ids, rng = encoding(), packing.text_ids(packing.default_ranks()), random.Random(2)
    alphabet = " \n\t\xa0a'stéZ1²!. 　\x1c\x85  \n<|endoftext|>日"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(15)))
        want = enc.encode_ordinary(text)
        assert ids(text) == struct.pack(f"<{len(want)}I", *want), repr(text)


def test_genetic_steps_keep_all_items():
    rng = random.Random(9)
    sizes = [rng.randrange(1, 100) for _ in range(120)]
    a = packing.best_fit(sizes, [], list(range(120)), 100)
    b = packing.best_fit(sizes, [], sorted(range(120), key=lambda i: -sizes[i]), 100)
    for made in (packing.crossover(sizes, a, b, 100, rng), packing.mutate(sizes, a, 100, rng), packing.with_migrants(sizes, [[sizes[0]], [5, 5, 5]], 100), packing.evolve(sizes, [a], 100, 1)):
        assert sorted(i for bin_ in made for i in bin_) == list(range(120))
        assert all(sum(sizes[i] for i in bin_) <= 100 for bin_ in made)
    assert len(packing.evolve(sizes, [a], 100, 1)) <= len(b)


def test_fingerprints(docs, texts):
    got = by_id(fingerprint.fingerprint_documents(docs, parts=5))
    n = len(texts)
    assert len(got) == n
    for i, r in got.items():
        t, nxt = texts[i] or "", texts[(i + 1) % n] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple(fingerprint.fingerprints([t, edited]))
    long = [r for i, r in got.items() if len(texts[i] or "") > 300]
    assert all(r["near_edited"] > 0.3 for r in long) and sum(r["near_edited"] > r["near_next"] for r in long) > 0.9 * len(long)
    assert fingerprint.fingerprint_documents(empty(docs), parts=3).count() == 0


def test_fingerprint_follows_edit_distance():
    """In the median: how long two walks stay apart after an edit has a long tail."""
    rng, few, many, turned = random.Random(1), [], [], []
    for _ in range(9):
        text = "".join(rng.choice("abcdefghij ") for _ in range(3000))
        cut, changed = list(text), list(text)
        for at in sorted(rng.sample(range(3000), 4), reverse=True):
            del cut[at]
        for at in rng.sample(range(3000), 100):
            changed[at] = rng.choice("xyz")
        a, b, c, d = fingerprint.fingerprints([text, "".join(cut), "".join(changed), text[::-1]])
        for out, other in ((few, b), (many, c), (turned, d)):
            out.append(fingerprint.likeness(a, other))
    few, many, turned = sorted(few)[4], sorted(many)[4], sorted(turned)[4]
    assert few > 0.9 and few > many > turned


@pytest.mark.parametrize("block", [256, 5])
def test_fingerprint_classes_against_all_pairs(spark, block):
    """Classes against every pair of fingerprints, and against edit distance: texts that differ by a few characters are found, others are left alone."""
    rng = random.Random(3)
    texts = [None, "", "", "x"]
    families = []
    for _ in range(25):
        t = prose(rng, rng.choice([12, 60, 200]))
        family = [t]
        for _ in range(rng.randrange(1, 5)):
            v = list(t)
            for _ in range(max(1, len(t) // 400)):
                at = rng.randrange(len(v) // 2, len(v))
                v[at : at + rng.randrange(2)] = rng.choice(["", "q", "zz"])
            family.append("".join(v))
        families.append(range(len(texts), len(texts) + len(family)))
        texts += family
    texts += [texts[5], texts[5]]
    d = spark.createDataFrame([(i, len(t or ""), p) for i, (t, p) in enumerate(zip(texts, fingerprint.fingerprints([t or "" for t in texts])))], "doc_id long, n_chars long, fingerprint string")
    prints = [r["fingerprint"] for r in d.orderBy("doc_id").collect()]
    got = {r["doc_id"]: r["class_id"] for r in fingerprint.near_classes(d, block=block).collect()}
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] and texts[j] and fingerprint.likeness(prints[i], prints[j]) >= 0.6]
    parent = list(range(len(texts)))
    for _ in texts:
        for i, j in alike:
            parent[i] = parent[j] = min(parent[i], parent[j])
    assert len(alike) > 60
    assert sum(got[i] == got[j] for i, j in alike) >= 0.98 * len(alike)
    # nothing is joined that a chain of pairs as alike does not join
    assert all(parent[i] == parent[got[i]] for i in range(len(texts)))
    near = [(i, j) for f in families for i in f for j in f if j < i and texts[i] != texts[j]]
    assert sum(got[i] == got[j] for i, j in near) >= 0.9 * len(near)
    assert [got[i] for i in (0, 1, 2, 3)] == [0, 1, 2, 3] and got[len(texts) - 1] == got[5]
    assert fingerprint.near_classes(d.filter("doc_id < 0")).count() == 0


def test_quality(spark):
    rng = random.Random(4)
    good = [prose(rng, rng.choice([20, 400])) for _ in range(60)]
    bad = [prose(rng, 30) + " " + " ".join(w.upper() + "!!" for w in prose(rng, 150).split()) for _ in range(40)]
    rows = [(i, t, int(i < 60)) for i, t in enumerate(good + bad)]
    d = spark.createDataFrame([*rows, (900, None, 0), (901, "", 0)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    model = quality.fit(d.select("doc_id", "text"), labels)
    got = by_id(quality.score_quality(d, model))
    held = [(got[i]["score"], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 10 and all((s >= 0.3) == (q == 1) for s, q in held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 102
    assert quality.fit(d.select("doc_id", "text"), labels.filter("quality = 1")) is None
    assert quality.score_quality(d, None).filter("score <> 0.5").count() == 0
    assert quality.score_quality(d.filter("doc_id < 0"), model).count() == 0


def test_lm_scoring_prefers_the_target(spark):
    rng = random.Random(8)
    a = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(50)) for _ in range(30)]
    b = [" ".join(rng.choice(["delta", "beta", "omega"]) for _ in range(50)) for _ in range(30)]
    d = spark.createDataFrame([*enumerate(a + b), (90, None), (91, " ")], "doc_id long, text string")
    got = by_id(lm_scoring.cross_entropy_difference(d, d.filter("doc_id < 20").select("doc_id")))
    assert max(got[i]["score"] for i in range(20, 30)) < min(got[i]["score"] for i in range(30, 60))
    assert got[90]["score"] == got[91]["score"] == 0.0
    none = by_id(lm_scoring.cross_entropy_difference(d, d.filter("doc_id < 0").select("doc_id")))
    assert len(none) == 62
    assert lm_scoring.cross_entropy_difference(d.filter("doc_id < 0"), d.select("doc_id")).count() == 0


def test_lm_scores_match_brute_force_over_all_words(spark):
    """Words beyond the most frequent 4,000, of equal shape, are told apart; small chunks exchange their counts."""
    rng = random.Random(14)
    common = [f"w{k}" for k in range(4000)]
    texts = [" ".join(common) for _ in range(20)]
    texts += [" ".join(rng.choice(common[:5] + [f"{kind}{k}" for k in range(20)]) for _ in range(30)) for kind in ("rare", "seld") for _ in range(12)]
    texts += [None, "", " \n", "\U0001f600 日本 x", texts[25]]
    goal = set(range(20, 29))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    words = [(t or "").split() for t in texts]
    counts = []
    for held in (range(len(texts)), goal):
        word, context, pair = (collections.Counter() for _ in range(3))
        for i in held:
            for a, b in zip([None, *words[i]], words[i]):
                word[b] += 1
                context[a] += 1
                pair[a, b] += 1
        counts.append((word, context, pair, sum(word.values())))
    size = len(counts[0][0])

    def loss(k, a, b):
        word, context, pair, total = counts[k]
        return -math.log((pair[a, b] + lm_scoring.PRIOR * (word[b] + 1) / (total + size)) / (context[a] + lm_scoring.PRIOR))

    targets = d.filter(F.col("doc_id").isin(sorted(goal))).select("doc_id")
    for chunk in (40, lm_scoring.CHUNK):
        got = by_id(lm_scoring.cross_entropy_difference(d, targets, chunk))
        assert len(got) == len(texts)
        for i, w in enumerate(words):
            want = sum(loss(1, a, b) - loss(0, a, b) for a, b in zip([None, *w], w)) / max(len(w), 1)
            assert got[i]["n_words"] == len(w) and abs(got[i]["score"] - want) < 1e-9
    odd = spark.createDataFrame([(None, "a b"), ((1 << 60) + 1, "b a")], "doc_id long, text string").coalesce(1)
    assert set(by_id(lm_scoring.cross_entropy_difference(odd, targets))) == {None, (1 << 60) + 1}
    assert max(got[i]["score"] for i in range(20, 32)) < min(got[i]["score"] for i in range(32, 44))


def test_license_scan_matches_brute_force(spark):
    """Against every run of lines and every template."""
    rng = random.Random(6)
    notices = [t for t in licenses.TEMPLATES.values() if len(t) < 200]
    lines = [*notices, "licensed under the apache license version 2.0", "Released under the MIT license today.", "mit", "", "Released under", "the MIT License.", "Licensed under CC", "BY 4.0. of the"]
    texts = ["\n".join(rng.choice(lines) if rng.random() < 0.6 else prose(rng, rng.randrange(12)) for _ in range(7)) for _ in range(60)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(licenses.scan_licenses(d))

    def pairs(s):
        w = re.findall(r"[^\W_]+(?:\.\d+)*", s.lower())
        return {(a, b) for a, b in zip(w, w[1:])}

    known = {n: pairs(t) for n, t in licenses.TEMPLATES.items()}
    for i, t in enumerate(texts):
        parts, made = (t or "").split("\n"), []
        for a in range(len(parts)):
            for z in range(a, len(parts)):
                own = pairs("\n".join(parts[a : z + 1]))
                made += [(-2 * len(own & b) / (len(own) + len(b)), z - a, a + 1, n) for n, b in known.items() if 2 * len(own & b) >= licenses.THRESHOLD * (len(own) + len(b))]
        want = []
        for dice, more, a, n in sorted(made):
            if all(a + more < o[0] or o[1] < a for o in want):
                want.append((a, a + more, n, round(-dice, 9)))
        assert [(s["line"], s["last_line"], s["name"], round(s["dice"], 9)) for s in got[i]["licenses"]] == sorted(want), t
    assert licenses.scan_licenses(d.filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("name", ["MIT-text", "BSD-3-Clause", "ISC"])
def test_wrapped_licenses_are_found(spark, name):
    """Whole licenses wrapped at 78 columns, between prose, with a changed holder and comment marks."""
    import textwrap

    rng = random.Random(2)
    body = textwrap.wrap(licenses.TEMPLATES[name].replace("COPYRIGHT HOLDERS", "EXAMPLE PEOPLE"), 78)
    head, tail = [prose(rng, 9) for _ in range(30)], [prose(rng, 9) for _ in range(20)]
    text = "\n".join(head + ["", "Copyright (c) 2020 Somebody", ""] + [f" * {x}" for x in body] + [""] + tail)
    d = spark.createDataFrame([(1, text), (2, "\n".join(head + tail))], "doc_id long, text string")
    got = by_id(licenses.scan_licenses(d))
    (one,) = got[1]["licenses"]
    assert one["name"] == name and one["dice"] > 0.9 and abs(one["line"] - 34) <= 1 and abs(one["last_line"] - 33 - len(body)) <= 1
    assert got[2]["licenses"] == []


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string")


def test_chat_events_fold(spark):
    rows = [
        (1, 1, "message", 0, "user", "Hi"), (1, 2, "message", 1, "assistant", ""), (1, 3, "delta", 1, None, "Hel"), (1, 4, "delta", 1, None, "lo"),
        (1, 5, "regenerate", 1, None, None), (1, 6, "delta", 1, None, "Bye"), (1, 7, "message", 2, "user", "more"), (1, 8, "edit", 0, None, "Hi!"),
        (1, 9, "message", 1, "assistant", "new"), (2, 1, "message", 0, "user", None), (None, 1, None, 0, None, "x"),
    ]
    got = collections.defaultdict(list)
    for r in sorted(chat_format.rebuild(events(spark, rows)).collect(), key=lambda r: (r["turn"], r["ord"])):
        got[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    # the edit of turn 0 discards the later turns opened before it; turn 1 is opened again after it
    assert got[1] == [(0, "user", "Hi!"), (1, "assistant", "new")]
    assert got[2] == [(0, "user", "")] and got[None] == [(0, "", "x")]


def test_chat_round_trip(spark):
    rng = random.Random(12)
    bits = ["\\", "#", "##", "###", "### ", "</turn>", "<\\/turn>", "\n", ": ", "assistant", "é\U0001f600", "x", ":", "\\#"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
    rows = [(c, t, "message", t, rng.choice(["user", "assistant", "a: b", text()]), text()) for c in range(60) for t in range(rng.randrange(1, 6))]
    p = chat_format.parse(chat_format.format_chats(events(spark, rows))).collect()
    assert len(p) == 60
    for r in p:
        own = [(x[4], x[5]) for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == own
        assert r["loss"] == "".join(t for role, t in own if role == "assistant")


def test_streamed_logs_fold_to_their_rows(spark):
    rng = random.Random(19)
    text = lambda: rng.choice([None, "", "a", "ab", "\U0001f600é", "### x </turn>", prose(rng, 9)])
    rows = [(c, t, rng.choice(["user", "assistant", None]), text()) for c in (None, 1, 2, -(1 << 62)) for t in (None, -3, 0, 1, 2, 3, 4, 1 << 62)]
    rows += [(1, 2, "user", "shared turn"), (2, None, "user", "x"), (2, 4, "user", "twice"), (2, 4, "user", "twice")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat_format.streamed_events(d)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = sorted((str(r["conv_id"]), str(r["turn"]), r["role"], r["text"]) for r in chat_format.rebuild(log).collect())
    assert got == sorted((str(c), str(t), r or "", x or "") for c, t, r, x in rows)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    good = [prose(rng, 80) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 150).split()) for _ in range(30)]
    texts = good + [good[0] + "\n", good[1] + " tail", "write to a@b.cd " + prose(rng, 30)] + bad
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 63), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        counts.append(docs.count())
    assert counts == [63, 62, 61, 61]
    assert docs.filter("text LIKE 'write to [email] %'").count() == 1
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r["doc_id"] for r in docs.collect()}


CLASHING = ("_kept_id", "_kept", "cls", "label", "maybe", "_maybe", "_word", "_bit", "_gone0", "h", "n", "cand", "row", "_text", "score", "_score", "chunk", "island", "bin", "place", "part", "text_sha256")


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, ids that repeat with other texts, repeated rows, null, empty and long texts, and columns named as inside the operators."""
    rng = random.Random(41)
    a, b = prose(rng, 60), prose(rng, 60)
    long = " ".join(rng.choice(WORDS) for _ in range(20_000))
    rows = [(None, a), (None, None), (5, a), (5, b), (7, a + " tail"), (8, b + " tail"), (9, None), (9, None), (10, ""), (11, long), (12, "x@y.zz " + prose(rng, 30)), (12, "x@y.zz " + prose(rng, 30)), (13, "one"), (14, "one")]
    rows += [(20 + k, prose(rng, 40)) for k in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.withColumns({c: F.lit(c) for c in CLASHING} | {"n_chars": F.length("text").cast("long")}).cache()


def operators(spark, labels):
    """Every operator as a function of a table, and whether it gives one row for each of the table's."""
    return {
        "exact": (exact_dedup.exact_dedup, True), "near": (near_dedup.near_dedup, True), "prints": (lambda d: fingerprint.fingerprint_documents(d, parts=3), True),
        "pii": (pii.find_pii, True), "bpe": (lambda d: bpe.encode(d, common=20), True), "packing": (packing.pack_documents, False), "licences": (licenses.scan_licenses, True),
        "quality": (lambda d: quality.score_quality(d, quality.fit(d, labels)), True), "lm": (lambda d: lm_scoring.cross_entropy_difference(d, d.filter("doc_id < 10")), True),
    }


def test_odd_rows_through_every_operator(spark, odd):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20, 30)] + [(None, 1, 0), (20, 0, 0)], "doc_id long, quality int, toxic int")
    rows = odd.count()
    for name, (op, each) in operators(spark, labels).items():
        got = op(odd).collect()
        assert (len(got) == rows) if each else {r["doc_id"] for r in got} == {r["doc_id"] for r in odd.collect()}, name
        assert op(odd.filter("doc_id < 0")).count() == 0, name
    turns = odd.select(F.col("doc_id").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), "text", *CLASHING)
    made = chat_format.parse(chat_format.format_chats(chat_format.conversation_events(turns))).collect()
    assert sum(len(r["turns"]) for r in made) == rows and len(made) == odd.select("doc_id").distinct().count()
    assert chat_format.format_chats(chat_format.conversation_events(turns.filter("conv_id < 0"))).count() == 0


def test_odd_rows_through_every_stage(spark, odd, tmp_path):
    spark.createDataFrame([(k, k % 2, 0) for k in range(20, 30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (quality.stage_quality, exact_dedup.stage_exact_dedup, near_dedup.stage_near_dedup, pii.stage_pii):
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns, stage
        got = out.count()
        assert 0 < got <= odd.count(), stage
        assert stage(spark, odd.filter("doc_id < 0"), str(tmp_path)).count() == 0, stage
    assert packing.stage_packing(spark, odd.filter("doc_id < 0"), str(tmp_path)).count() == 0
    kept = exact_dedup.stage_exact_dedup(spark, odd, str(tmp_path)).groupBy("doc_id", "text").count().collect()
    # of a null id and 5 with the same text 5 stays; of the two rows 9 both, as they are one id
    assert {(r["doc_id"], r["text"] is None): r["count"] for r in kept if r["doc_id"] in (None, 9)} == {(9, True): 2}


def test_near_dedup_of_repeated_ids(spark, odd):
    """One id with two texts links to what is near either."""
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near_dedup.near_dedup(odd).collect()}
    assert got[7, 57] == 5 and got[8, 57] == 5 and got[None, 56] is None


@pytest.mark.parametrize(("percent", "node", "length", "changes"), [(85, 16, 120, 2), (85, near_dedup.NODE, 120, 2), (80, 16, 130, 3), (80, near_dedup.NODE, 130, 3)])
def test_near_dedup_recall_on_planted_pairs(spark, percent, node, length, changes):
    """Pairs just over the threshold, in a crowd that shares a passage with all of them, so that nodes are large and branch."""
    rng = random.Random(77)
    shared = prose(rng, 12).split()
    texts = []
    for _ in range(150):
        w = shared + prose(rng, length).split()
        v = list(w)
        for at in rng.sample(range(20, length + 5), changes):
            v[at] = "changed" + str(rng.randrange(10**6))
        texts += [" ".join(w), " ".join(v)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, component = brute_components(texts, percent)
    linked = [i for i in range(len(texts)) if component[i] != i]
    got = by_id(near_dedup.near_dedup(d, percent, node=node))
    assert len(linked) > 100
    assert sum(got[i]["component_id"] == component[i] for i in linked) >= 0.98 * len(linked)
    assert all(got[i]["component_id"] == i for i in range(len(texts)) if component[i] == i)
