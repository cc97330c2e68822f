"""Personal data by weak supervision, in DataFrame functions only.

Base spans are the matches of four fixed patterns (e-mail address, IP address, payment card, phone number) that pass
their checks; they always stay. Candidates are these, matches that fail a check, and looser forms: an address with
"(at)" and "(dot)", a phone number without its country code. Six labelers vote for, against or not at all on each
candidate: shape and checksum by regular expression, two gazetteers (of endings and number prefixes, and of forms that
are no personal data), words of the context before it that speak for or against, and the character after it.

The votes are counted by pattern: at most four kinds times three to the power of six rows, whatever the input. On
these counts expectation-maximisation estimates how often each labeler votes for and against true and false candidates,
with one share of true candidates per kind, and so the probability of each pattern. A logistic classifier on votes, their
products with the kind, and kind is then fitted to these probabilities; candidates that it scores at least ``threshold``
are added, if they touch no base span. Both fits read counts only; scoring is one expression per candidate.

Null texts count as empty and have no spans. Null and repeated ids are carried through, one result per row. An empty
table gives an empty result. Other columns are not looked at. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftline.llm.frames import checkpointed, column

KINDS = ("email", "ip", "card", "phone")
THRESHOLD, ROUNDS, STEPS = 0.7, 60, 400
CONTEXT = 48
#: How often a labeler is taken to vote against, not, and for: on false candidates, on true ones.
PRIOR = ({-1: 0.4, 0: 0.4, 1: 0.2}, {-1: 0.05, 0: 0.45, 1: 0.5})

# Possessive forms of the base patterns: equal matches without backtracking, so that no text takes quadratic time. An
# address may start right after the last match (\G) or where no character of its own class stands before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?[(\[]dot[)\]]\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+.)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: What a text must hold for its pattern to be tried at all.
HINTS = {"email": "@", "phone": "+"}

#: Votes for: common endings of addresses; issuers' first digits; country codes and test exchanges.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|it|nl|ch|at|eu|uk|us)$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+(?:1|33|34|39|41|43|44|49|7)(?![0-9]{12})|\(?[2-9][0-9]{2})",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
}
#: Votes against: forms of versions, dates, measures and made-up numbers.
NO_DATA = {
    "email": r"(?i)^(?:.*\.(?:png|jpe?g|gif|svg|js|css))$",
    "card": r"^(?:0|([0-9])\1{7})|^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])",
    "phone": r"^\(?[01]|0000",
    "ip": r"^0*[0-3]\.0*[0-9]\.0*[0-9]\.0*[0-9]{1,2}$",
}
CUES_FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address|kontakt|schreib\w*|courriel|adresse|correo)\b",
    "ip": r"(?i)\b(?:ip|ipv4|host|server|address|client|login|from|node|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|pay|karte|carte|tarjeta|iban)\b",
    "phone": r"(?i)\b(?:call|phone|tel|telephone|fax|mobile|cell|dial|sms|whatsapp|telefon|handy|t[eé]l[eé]fono?)\b",
}
CUES_AGAINST = {
    "email": r"(?i)\b(?:git|ssh|version)\b",
    "ip": r"(?i)\b(?:version|release|build|section|chapter|kernel|v|rev|revision)\s*$",
    "card": r"(?i)\b(?:isbn|order|invoice|serial|tracking|timestamp|hash|id|no|nr|figure)\b\W*$",
    "phone": r"(?i)\b(?:order|invoice|part|serial|id|isbn|figure|version)\b\W*$",
}
LABELERS = ("shape", "gazetteer", "form", "cue", "counter", "after")

_SPAN = "struct<start: int, end: int, value: string, before: string, after: string>"


def _found(text: Column, pattern: str, hint: str | None) -> Column:
    """All matches as structs: the pieces between them give the places."""
    has = F.contains(text, F.lit(hint)) if hint else text.rlike(pattern)
    values = F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.when(F.size(values) > 0, values)


def _placed(text: Column, values: Column, pattern: str) -> Column:
    gaps = F.split(text, pattern, -1)  # evaluated for texts with matches only
    empty = F.from_json(F.lit("[]"), f"array<{_SPAN}>")
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), gaps.alias("gaps"), empty.alias("spans"))

    def step(s: Column, value: Column) -> Column:
        gap = F.element_at(s["gaps"], s["i"] + 1)
        start = s["at"] + F.char_length(gap)
        end = start + F.char_length(value)
        span = F.struct(start.alias("start"), end.alias("end"), value.alias("value"), F.right(gap, F.lit(CONTEXT)).alias("before"),
                        F.left(F.element_at(s["gaps"], s["i"] + 2), F.lit(2)).alias("after"))
        return F.struct(end.alias("at"), (s["i"] + 1).alias("i"), s["gaps"].alias("gaps"), F.concat(s["spans"], F.array(span)).alias("spans"))

    return F.when(values.isNull(), empty).otherwise(F.aggregate(values, state, step, lambda s: s["spans"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' sum, every second from the right doubled and reduced to one digit, ends with 0."""
    n = F.char_length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def is_base(kind: str, value: Column) -> Column:
    """Whether a match of the base pattern passes its kind's check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    n = F.char_length(_digits(value))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), luhn(_digits(value))).otherwise(False)


def _vote(pro: Column, contra: Column) -> Column:
    return F.when(contra, -1).when(pro, 1).otherwise(0)


def _votes(kind: str, value: Column, before: Column, after: Column, passes: Column) -> list[Column]:
    """One vote of each labeler: 1 for, -1 against, 0 none."""
    none = F.lit(False)
    digits = F.char_length(_digits(value))
    shape = {"email": _vote(value.contains("@"), none), "ip": _vote(passes, ~passes), "card": _vote(passes, ~passes),
             "phone": _vote(digits.between(10, 12), ~digits.between(9, 15))}[kind]
    body = _digits(value) if kind == "card" else value
    return [shape, _vote(body.rlike(GAZETTEER[kind]), none), _vote(none, body.rlike(NO_DATA[kind])), _vote(before.rlike(CUES_FOR[kind]), none),
            _vote(none, before.rlike(CUES_AGAINST[kind])), _vote(after.rlike(r"^(?:$|[\s,;:!?)\]]|\.(?:\s|$))"), after.rlike(r"^[A-Za-z0-9/%=_]"))]


def _candidates(kind: str, matches: Column, loose: Column | None) -> Column:
    def labelled(x: Column, base: Column) -> Column:
        votes = _votes(kind, x["value"], x["before"], x["after"], base)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), base.alias("base"),
                        *[v.alias(name) for v, name in zip(votes, LABELERS)])

    # a run of digits is a candidate for a card only if it has about as many digits as one
    if kind == "card":
        matches = F.filter(matches, lambda x: F.char_length(_digits(x["value"])).between(13, 19))
    found = F.transform(matches, lambda x: labelled(x, is_base(kind, x["value"])))
    return found if loose is None else F.concat(found, F.transform(loose, lambda x: labelled(x, F.lit(False))))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc and found: an array of candidates with kind, start, end, base and votes."""
    rows = docs.select(column(docs, id_col).alias("doc"), F.coalesce(column(docs, text_col), F.lit("")).alias("text"))
    text = F.col("text")
    tried = {("base", k): (p, HINTS.get(k)) for k, p in PATTERNS.items()} | {("loose", k): (p, None) for k, p in LOOSE.items()}
    rows = rows.select("doc", "text", *[_found(text, p, hint).alias(f"{a}_{k}") for (a, k), (p, hint) in tried.items()])
    rows = rows.select("doc", *[_placed(text, F.col(f"{a}_{k}"), p).alias(f"{a}_{k}") for (a, k), (p, _) in tried.items()])
    every = [_candidates(k, F.col(f"base_{k}"), F.col(f"loose_{k}") if k in LOOSE else None) for k in KINDS]
    return rows.select("doc", F.concat(*every).alias("found"))


@dataclass
class Classifier:
    """Weights of the final span classifier: by kind, and by labeler and vote."""

    kinds: dict[str, float]
    votes: dict[tuple[str, int], float]

    def margin(self, x: Column) -> Column:
        kind = reduce(lambda c, k: c.when(x["kind"] == k, self.kinds[k]), self.kinds, F.when(F.lit(False), 0.0))
        parts = [F.when(x[name] == v, w).otherwise(0.0) for (name, v), w in self.votes.items()]
        return reduce(lambda a, b: a + b, parts, kind)


def estimate(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = ROUNDS) -> list[float]:
    """The probability that a candidate with this kind and votes is true, by expectation-maximisation over the counts.

    Starts from the majority of votes. Labelers are taken as independent given the truth; a vote not cast counts too.
    Votes alone don't say which of the two classes is the true one, and one odd text may hold most candidates: so a tenth
    of all weight is a prior by which a labeler votes for true candidates more often than for false ones.
    """
    strength = 20 + 0.1 * sum(n for *_, n in counts)
    posterior = [1 / (1 + math.exp(-2.0 * sum(votes))) for _, votes, _ in counts]
    for _ in range(rounds):
        share = {k: (0.5 * strength, strength) for k in KINDS}
        tables: dict[tuple[int, int, int], float] = {}
        totals = [1e-9, 1e-9]
        for (kind, votes, n), p in zip(counts, posterior):
            a, b = share[kind]
            share[kind] = (a + n * p, b + n)
            for truth, weight in ((1, n * p), (0, n * (1 - p))):
                totals[truth] += weight
                for j, v in enumerate(votes):
                    tables[j, v, truth] = tables.get((j, v, truth), 0.0) + weight
        rate = lambda j, v, truth: (tables.get((j, v, truth), 0.0) + strength * PRIOR[truth][v]) / (totals[truth] + strength)
        new = []
        for kind, votes, _ in counts:
            a, b = share[kind]
            odds = math.log(a / b) - math.log(max(1e-9, 1 - a / b)) + sum(math.log(rate(j, v, 1) / rate(j, v, 0)) for j, v in enumerate(votes))
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        moved = max((abs(x - y) for x, y in zip(new, posterior)), default=0.0)
        posterior = new
        if moved < 1e-6:
            break
    return posterior


def train(counts: list[tuple[str, tuple[int, ...], int]], steps: int = STEPS) -> Classifier:
    """A logistic classifier of kind and votes, fitted to the estimated probabilities by gradient steps."""
    counts = sorted(counts)
    targets = estimate(counts)
    model = Classifier({k: 0.0 for k in KINDS}, {(name, v): 0.0 for name in LABELERS for v in (-1, 1)})
    total = sum(n for *_, n in counts)
    for _ in range(steps if total else 0):
        kinds, votes_ = dict.fromkeys(model.kinds, 0.0), {k: 1e-3 * w for k, w in model.votes.items()}
        for (kind, votes, n), target in zip(counts, targets):
            own = [(name, v) for name, v in zip(LABELERS, votes) if v]
            margin = model.kinds[kind] + sum(model.votes[x] for x in own)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))) - target) * n / total
            kinds[kind] += error
            for x in own:
                votes_[x] += error
        for k in kinds:
            model.kinds[k] -= 2.0 * kinds[k]
        for k in votes_:
            model.votes[k] -= 2.0 * votes_[k]
    return model


def vote_counts(found: DataFrame) -> list[tuple[str, tuple[int, ...], int]]:
    """How often each kind and pattern of votes occurs: at most len(KINDS) * 3 ** len(LABELERS) rows."""
    rows = found.select(F.explode("found").alias("x")).groupBy("x.kind", *[f"x.{n}" for n in LABELERS]).count().collect()
    return sorted((r["kind"], tuple(int(r[n]) for n in LABELERS), int(r["count"])) for r in rows)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc, base and spans: arrays of (kind, start, end) by kind, then start; spans has the base and what is added."""
    found = checkpointed(candidates(docs, id_col, text_col))
    model = train(vote_counts(found))
    cut = math.log(threshold / (1 - threshold))
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.transform(F.filter("found", lambda x: x["base"]), plain)
    more = F.transform(F.filter("found", lambda x: ~x["base"] & (model.margin(x) >= cut)), plain)
    rows = found.select("doc", base.alias("base"), more.alias("more"))
    free = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])))
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    ordered = F.array_sort(F.transform(F.concat("base", "free"), lambda x: F.struct(
        rank(x).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    rows = rows.withColumn("free", free).select("doc", "base", ordered.alias("spans"))
    return rows.select("doc", "base", F.transform("spans", plain).alias("spans"))


def joined(array: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def number(array: str, kind: str) -> Column:
    """How many spans of a kind."""
    return F.size(F.filter(array, lambda x: x["kind"] == kind)).cast("long")
