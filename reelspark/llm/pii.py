"""PII by weak supervision: labelers vote on spans, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import fresh, read, saved, text_or_empty

#: Base kinds: pattern of the match, in the order of the result. Each is the plain pattern with possessive runs
#: and a left edge (a run's start or the previous match's end), which match the same spans without backtracking.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
#: Further candidates: words of eight or more letters and digits that hold a digit.
TOKEN = r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{8,}+"
#: Gazetteer and context words, looked for in the characters before a candidate.
CUES = ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "access key", "bearer", "ssn", "passport", "iban", "account", "license no", "customer no", "user id")
LOCAL_CUES = r"(?i)(?:" + "|".join(CUES) + r")[\"'\x20]*[:=]?[\"'\x20]*$"
#: What leads to a value: a cue as a word of its own, then quotes, blanks and a sign of assignment, if any.
LEAD = r"(?<![A-Za-z0-9])(?=[TSPABILCUtspabilcu])(?i:" + "|".join(CUES) + r")(?![A-Za-z0-9_])[\"'\x20\t]*+[:=]?[\"'\x20\t]*+"
#: The value: what the quotes hold; groups of capitals and digits, parted by single blanks or dashes; else all up to white space.
VALUE = (
    r"(?:(?<=\")[^\"\n]++(?=\")|(?<=')[^'\n]++(?=')"
    r"|(?=[A-Z\x20-]*+[0-9])[A-Z0-9]++(?![A-Za-z_])(?:[\x20-][A-Z0-9]++(?![A-Za-z_]))*+(?![^\s\"',;.:!?)])"
    r"|[^\s\"',;]*[^\s\"',;.:!?)])"
)
CONTEXT = 32
ADDED = ("account", "secret")
LABELERS = ("shape_hex", "shape_long", "gazetteer", "assigned", "plain_number", "word_like")


#: Items that a running fold appends to at once; results are joined block by block, so that its work is linear in the items.
BLOCK = 128


def let(value: Column, body) -> Column:
    """body of value, which is worked out once however often body names it; an expression named inside a function of an array's items would be worked out for each."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, zero: Column, step, kind: str) -> Column:
    """The state after each of an array's items, step(state, item) from zero on; kind is the state's type. items must be a column or a bound value."""
    none, states = F.array().cast(f"array<{kind}>"), lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def one(acc: Column, x: Column) -> Column:
        return let(step(acc["at"], x), lambda new: states(new, F.array_append(acc["out"], new)))

    def block(acc: Column, k: Column) -> Column:
        made = F.aggregate(F.slice(items, k * BLOCK + 1, F.lit(BLOCK)), states(acc["at"], none), one)
        return let(made, lambda m: states(m["at"], F.array_append(acc["out"], m["out"])))

    first = states(zero, F.array().cast(f"array<array<{kind}>>"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    return F.when(F.size(items) == 0, none).otherwise(F.flatten(F.aggregate(blocks, first, block, lambda acc: acc["out"])))


def _spans(text: Column, pattern: str, maybe: Column, fields=lambda match, left: {}) -> Column:
    """Array of start, end (code points, end exclusive), match and more fields, for each match in order."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(both: Column) -> Column:
        ends = running(both, F.lit(0), lambda at, x: at + F.length(x["left"]) + F.length(x["match"]), "int")
        return F.zip_with(both, ends, lambda x, e: F.struct((e - F.length(x["match"])).alias("start"), e.alias("end"), x["match"].alias("match"), *[v.alias(k) for k, v in fields(x["match"], x["left"]).items()]))

    both = let(matches, lambda m: F.zip_with(F.slice(between, F.lit(1), F.size(m)), m, lambda a, b: F.struct(a.alias("left"), b.alias("match"))))
    return F.when(maybe, let(both, placed))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check."""
    figures = F.split(F.reverse(digits), "")
    def add(acc: Column, x: Column) -> Column:
        return acc + x

    doubled = F.transform(figures, lambda f, i: F.when(f == "", 0).otherwise(F.when(i % 2 == 0, f.cast("int")).otherwise(f.cast("int") * 2 - F.when(f.cast("int") > 4, 9).otherwise(0))))
    return F.length(digits).between(13, 19) & (F.aggregate(doubled, F.lit(0), add) % 10 == 0)


def _octets(match: Column) -> Column:
    small = lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255)
    return F.forall(F.split(match, r"\."), lambda p: small(F.regexp_replace(p, "^0+(?=.)", "")))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind: leftmost non-overlapping matches, those that fail the kind's check dropped."""
    digit = text.rlike("[0-9]")
    found = {
        "email": F.when(text.contains("@"), _spans(text, EMAIL, F.lit(True))),
        "ip": F.when(digit & text.contains("."), F.filter(_spans(text, IP, F.lit(True)), lambda s: _octets(s["match"]))),
        "card": F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), F.filter(_spans(text, CARD, F.lit(True)), lambda s: _luhn(_digits(s["match"])))),
        "phone": F.when(digit & text.contains("+"), F.filter(_spans(text, PHONE, F.lit(True)), lambda s: F.length(_digits(s["match"])).between(9, 15))),
    }
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return {k: F.coalesce(plain(v), F.array().cast("array<struct<start:int,end:int>>")) for k, v in found.items()}


def _shape(match: Column) -> dict[str, Column]:
    return {
        "length": F.least(F.length(match), F.lit(48)),
        "letters": F.length(match) - F.length(_digits(match)),
        "hex": match.rlike("^[0-9a-fA-F]+$"),
    }


def candidate_spans(text: Column) -> Column:
    """Words that may be personal or secret and values that follow a cue, with the features that labelers and classifier
    read, by start. The shape of a value is that of its letters, digits and marks without blanks and dashes."""
    def fields(match: Column, left: Column) -> dict[str, Column]:
        near = F.right(left, F.lit(CONTEXT))
        return {**_shape(match), "cue": near.rlike(LOCAL_CUES), "assigned": near.rlike("[:=][\"'\\x20]*$")}

    def value(s: Column) -> Column:
        lead = F.regexp_extract(s["match"], "^" + LEAD, 0)
        match = F.substring(s["match"], F.length(lead) + 1, F.length(s["match"]))
        shape = _shape(F.regexp_replace(match, r"[\x20-]", ""))
        named = {"start": s["start"] + F.length(lead), "end": s["end"], "match": match, **shape, "cue": F.lit(True), "assigned": lead.rlike("[:=]")}
        return F.struct(*[v.alias(k) for k, v in named.items()])

    kind = "array<struct<start:int,end:int,match:string,length:int,letters:int,hex:boolean,cue:boolean,assigned:boolean>>"
    words = F.coalesce(F.when(text.rlike("[0-9]"), _spans(text, TOKEN, F.lit(True), fields)), F.array().cast(kind))
    values = F.coalesce(F.when(text.rlike(LEAD), F.transform(_spans(text, LEAD + VALUE, F.lit(True)), value)).cast(kind), F.array().cast(kind))
    # of a word and a value in the same place the word stays; sorted, they are neighbours
    ranked = lambda found, rank: F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(rank).alias("rank"), c.alias("c")))
    same = lambda a, b: F.coalesce((a["start"] == b["start"]) & (a["end"] == b["end"]), F.lit(False))
    alone = lambda both: F.transform(F.filter(both, lambda x, i: ~same(F.get(both, i - 1), x)), lambda x: x["c"])
    return let(F.array_sort(F.concat(ranked(words, 0), ranked(values, 1))), alone)


def apart(spans: Column, others: Column) -> Column:
    """The spans, by start, that overlap none of the others: told by how far the others before a place reach, and where the next begins."""
    mark = lambda found, other: F.transform(found, lambda s, i: F.struct(s["start"].alias("start"), F.lit(other).alias("other"), i.alias("i"), s["end"].alias("end")))

    def free(both: Column) -> Column:
        reach = running(both, F.lit(0), lambda far, x: F.greatest(far, F.when(x["other"] == 0, x["end"]).otherwise(0)), "int")
        back = F.reverse(both)
        begin = let(back, lambda r: F.reverse(running(r, F.lit(2**31 - 1), lambda low, x: F.least(low, F.when(x["other"] == 0, x["start"]).otherwise(2**31 - 1)), "int")))
        told = F.zip_with(F.zip_with(both, reach, lambda x, r: F.struct(x.alias("x"), r.alias("reach"))), begin, lambda y, b: F.struct(y["x"].alias("x"), ((y["reach"] <= y["x"]["start"]) & (b >= y["x"]["end"])).alias("free")))
        return F.transform(F.filter(told, lambda y: (y["x"]["other"] == 1) & y["free"]), lambda y: F.get(spans, y["x"]["i"]))

    return F.when(F.size(others) == 0, spans).otherwise(let(F.array_sort(F.concat(mark(others, 0), mark(spans, 1))), free))


def outermost(spans: Column) -> Column:
    """Of spans by start, then end, no two alike, those inside no longer one: none before reaches as far, and none after begins there."""
    reach = running(spans, F.lit(-1), lambda far, s: F.greatest(far, s["end"]), "int")
    return let(reach, lambda r: F.filter(spans, lambda s, i: (F.coalesce(F.get(r, i - 1), F.lit(-1)) < s["end"]) & F.coalesce(F.get(spans, i + 1)["start"] != s["start"], F.lit(True))))


def labeler_votes(c: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1 personal or secret, -1 not, 0 no vote. None votes against what is
    assigned to a cue for its shape: numbers may be short there, and passwords words."""
    pure = c["letters"] == 0
    told = c["cue"] & c["assigned"]
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no & ~told, -1).otherwise(0)
    return {
        "shape_hex": vote(c["hex"] & (c["letters"] > 0) & (c["length"] >= 20), ~c["hex"] & (c["length"] < 12)),
        "shape_long": vote(c["length"] >= 24, c["length"] < 10),
        "gazetteer": vote(c["cue"]),
        "assigned": vote(c["assigned"], ~c["assigned"] & (c["length"] < 16)),
        "plain_number": vote(pure & (c["length"] >= 13), pure & (c["length"] < 11)),
        "word_like": vote(F.lit(False), (c["letters"] > 0) & (c["letters"] >= c["length"] - 2)),
    }


def fit_reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict[tuple[int, int], float]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over counted vote patterns: the share of true spans, each labeler's vote
    probabilities by class, each pattern's posterior. Patterns are at most 3 ** len(LABELERS), whatever the input."""
    post = {p: 1 / (1 + math.exp(-1.5 * sum(p))) for p, _ in patterns}
    prior, tables = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in patterns) or 1
        prior = min(0.99, max(0.01, sum(post[p] * n for p, n in patterns) / total))
        tables = []
        for k in range(len(LABELERS)):
            mass = {(v, y): 1.0 for v in (-1, 0, 1) for y in (0, 1)}
            # a vote is right more often than not: this prior keeps the classes from changing places
            mass[1, 1] += 4
            mass[-1, 0] += 4
            for p, n in patterns:
                mass[p[k], 1] += post[p] * n
                mass[p[k], 0] += (1 - post[p]) * n
            sums = {y: sum(mass[v, y] for v in (-1, 0, 1)) for y in (0, 1)}
            tables.append({(v, y): m / sums[y] for (v, y), m in mass.items()})
        for p, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[v, 1] / t[v, 0]) for t, v in zip(tables, p))
            post[p] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return prior, tables, post


FEATURES = ("one", "long", "mid", "mixed", "hex", "cue", "assigned", "cue_or_assigned_long", "cue_and_assigned")


def feature_columns(c: Column) -> dict[str, Column]:
    as_int = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    return {
        "one": F.lit(1),
        "long": as_int(c["length"] >= 24),
        "mid": as_int(c["length"].between(13, 23)),
        "mixed": as_int((c["letters"] > 0) & (c["letters"] < c["length"] - 2)),
        "hex": as_int(c["hex"]),
        "cue": as_int(c["cue"]),
        "assigned": as_int(c["assigned"]),
        "cue_or_assigned_long": as_int((c["cue"] | c["assigned"]) & (c["length"] >= 12)),
        "cue_and_assigned": as_int(c["cue"] & c["assigned"]),
    }


def fit_classifier(rows: list[tuple[tuple[int, ...], float, int]], rounds: int = 40, decay: float = 1.0) -> list[float]:
    """Logistic regression on counted feature patterns with soft targets, by Newton's steps, so that patterns of few
    candidates are fit too; at most 2 ** len(FEATURES) rows."""
    weights = np.zeros(len(FEATURES))
    if not rows:
        return weights.tolist()
    x, target, n = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((n * (np.logaddexp(0, z) - target * z)).sum() + decay * (w @ w) / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (p - target)) + decay * weights
        step, size = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + decay * np.eye(len(weights)), slope), 1.0
        while size > 1e-6 and loss(weights - size * step) > loss(weights):
            size /= 2
        weights = weights - size * step
    return weights.tolist()


def find_pii(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """One row per input row: doc_id, spans (array of kind, start, end; code points, end exclusive), in the order
    of the kinds email, ip, card, phone, account, secret, then of start; with carry, the whole input row as a struct of that name.

    Base kinds are always in the result. Other candidates that overlap no base span are voted on by the labelers; their reliabilities
    come from expectation-maximisation over all candidates, a logistic span classifier is trained on the
    posteriors, and candidates that it scores at the threshold or above are added, but for those inside another. A null text counts as empty;
    empty texts and tables have no spans; repeated rows are kept, each with its spans. Texts are read once and whole;
    the spans are written and the counted vote and feature patterns (a bounded number) reach the driver.
    """
    text = text_or_empty(text_col)
    base = base_spans(F.col("_text"))
    row = [F.struct(*docs.columns).alias(carry)] if carry else []
    kept = ["doc_id", carry] if carry else ["doc_id"]
    found = docs.select(F.col(id_col).alias("doc_id"), *row, text.alias("_text")).select(*kept, *[v.alias(k) for k, v in base.items()], candidate_spans(F.col("_text")).alias("cand"))
    free = let(F.concat(*BASE), lambda bases: let(F.col("cand"), lambda cand: apart(cand, bases)))
    found = found.withColumn("cand", F.transform(free, lambda c: c.dropFields("match")))
    found = saved(found, "pii")
    each = found.select(F.explode("cand").alias("c"))
    named = lambda cols: [v.alias(k) for k, v in cols.items()]
    table = each.select(F.struct(*named(labeler_votes(F.col("c")))).alias("v"), F.struct(*named(feature_columns(F.col("c")))).alias("x")).groupBy("v", "x").count().collect()
    counts: dict[tuple[int, ...], int] = {}
    for r in table:
        counts[tuple(r["v"])] = counts.get(tuple(r["v"]), 0) + r["count"]
    _, _, post = fit_reliabilities(sorted(counts.items()))
    soft: dict[tuple[int, ...], list[float]] = {}
    for r in table:
        mass = soft.setdefault(tuple(r["x"]), [0.0, 0])
        mass[0] += post[tuple(r["v"])] * r["count"]
        mass[1] += r["count"]
    weights = fit_classifier([(x, m / n, n) for x, (m, n) in sorted(soft.items())])

    def accepted(c: Column) -> Column:
        odds = F.lit(0.0)
        for w, v in zip(weights, feature_columns(c).values()):
            odds = odds + F.lit(float(w)) * v
        return odds >= math.log(threshold / (1 - threshold))

    def of_kind(k: str, spans: Column | str) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    kinds = [of_kind(k, k) for k in BASE]
    found = found.withColumn("cand", F.filter("cand", accepted))
    added = let(F.col("cand"), outermost)
    kinds += [of_kind("account", F.filter(added, lambda c: c["letters"] == 0)), of_kind("secret", F.filter(added, lambda c: c["letters"] > 0))]
    return found.select(*kept, F.concat(*kinds).alias("spans"))


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


#: Code points of the segments that a text is cut into before its pieces are, as finding a place takes as long as what lies before it.
SEGMENT = 4096


def masked(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; of spans that overlap, the first to start masks, and what follows the longest of them is text again."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("longest"), s["kind"].alias("kind"), s["end"].alias("end"))))
    at = lambda x: F.floor(x / SEGMENT).cast("int")
    cut = F.transform(F.sequence(F.lit(0), at(F.length(text))), lambda k: F.substring(text, k * SEGMENT + 1, F.lit(SEGMENT)))

    def between(segments: Column, lo: Column, hi: Column) -> Column:
        part = lambda k: F.substring(F.get(segments, k), F.greatest(lo - k * SEGMENT, F.lit(0)) + 1, F.least(hi, (k + 1) * SEGMENT) - F.greatest(lo, k * SEGMENT))
        return F.when(hi > lo, F.array_join(F.transform(F.sequence(at(lo), at(hi - 1)), part), "")).otherwise("")

    def pieces(found: Column, segments: Column) -> Column:
        reach = running(found, F.lit(0), lambda far, s: F.greatest(far, s["end"]), "int")

        def parts(r: Column) -> Column:
            before = lambda i: F.coalesce(F.get(r, i - 1), F.lit(0))
            shown = F.transform(found, lambda s, i: F.when(s["start"] >= before(i), F.concat(between(segments, before(i), s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(""))
            return F.concat(F.array_join(shown, ""), between(segments, F.element_at(r, -1), F.length(text)))

        return let(reach, parts)

    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, lambda found: let(cut, lambda segments: pieces(found, segments))))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents stay, personal data in their texts replaced by its kind; n_chars follows. A null text stays
    null, empty and repeated texts stay, an empty table stays empty, all columns stay."""
    row = fresh(docs, "_row")
    found = find_pii(docs, carry=row)
    text = F.col(row)["text"]
    out = {"text": F.when(text.isNotNull(), masked(text, F.col("spans")))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length(out["text"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*[out[c].alias(c) if c in out else F.col(row)[c].alias(c) for c in docs.columns])


QUERIES = {"op7_pii": op7_pii}
ORACLE: dict[str, str] = {}
