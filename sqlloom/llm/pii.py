"""Personal data by weak supervision: base patterns, voting labelers, EM and a span classifier (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.functions.relational import once

# fixed values: the base kinds of the contract in its order, then those that the labelers add
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("secret", "national_id", "local_phone", "iban", "person")
KINDS = BASE_KINDS + MORE_KINDS

# Marks inside a working copy of the text, one code point each so that places stay as they are.
# A text that holds one of them gets U+F8FF there, which no pattern matches.
_CUT, _DOT, _GAP = "\ue000", "\ue001", "\ue002"
_FOREIGN = f"[{_CUT}{_DOT}{_GAP}]"

_LOCAL = r"A-Za-z0-9._%+\-" + _DOT
# Patterns are written without repeated groups, which the regex engine would run by recursion, and
# start at the beginning of a run, so that a long run is not scanned again from each of its characters.
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9\-{_DOT}]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"[0-9][0-9{_GAP}]++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

# fixed values: gazetteers and context words
_TLDS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|biz"
_FIRST_NAMES = ("James|John|Robert|Michael|William|David|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Sarah|Anna|Peter|"
                "Hans|Klaus|Ursula|Jean|Pierre|Marie|Sophie|Luis|Carlos|Maria|Carmen")
_COUNTRIES = "AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE"
_CONTEXT = (r"(?i)(?:e-?mail|phone|\btel|\bcall\b|\bfax\b|card|visa|credit|account|iban|\bssn\b|social security|passw|token|secret|"
            r"\bkey\b|\bname\b|contact|address|server|login|\bip\b)")
_AGAINST = r"(?i)(?:version|isbn|figure|section|page|chapter|order no|invoice|ticket|release)[^.!?]{0,15}$"

_MORE = "|".join((
    r"(?i:password|passwd|secret|token|api[_-]?key)[\"']? ?[:=] ?[\"']?[A-Za-z0-9+/_-]{8,}+",
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9+])(?<!\+[0-9] )\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
    rf"\b(?:{_COUNTRIES})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}\b",
    r"\b(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]++(?: [A-Z][a-z]++)?",
    rf"\b(?:{_FIRST_NAMES}) [A-Z][a-z]{{2,}}+\b",
))
_MORE_KIND = (
    ("person", r"^(?:(?:Mr|Mrs|Ms|Dr|Prof)\. |(?:" + _FIRST_NAMES + ") )"),
    ("national_id", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
    ("local_phone", r"^\("),
    ("iban", rf"^(?:{_COUNTRIES})[0-9]{{2}}[ A-Z0-9]+$"),
)

_SPAN = "array<struct<kind:int,start:bigint,end:bigint,text:string,before:string>>"
_BLOCK = 4096
VOTERS = ("shape", "gazetteer", "context", "against", "placeholder")
FEATURES = ("kind", *VOTERS, "length", "digits")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + d

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _before(df: DataFrame, names: dict[str, str], value: Callable[[Column], Column], combine: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds arrays: what ``combine`` (from 0) makes of the values of all earlier elements, for each element of the named arrays.

    A fold copies its state at every step, so gathering these values in one would cost the square of the length.
    Here runs of 64 values are combined first, only the runs' results are gathered, and an element adds the earlier ones of its run.
    """
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("sum"), F.array().cast("array<bigint>").alias("all"))

    def runs(v: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 64).cast("int")), lambda r: F.aggregate(F.slice(v, r * 64 + 1, F.lit(64)), zero, combine))

    def earlier(r: str) -> Column:
        return F.aggregate(r, start, lambda acc, x: F.struct(
            combine(acc["sum"], x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all")), lambda acc: acc["all"])

    def each(v: str, o: str) -> Column:
        return F.transform(v, lambda x, i: F.aggregate(F.slice(v, i - i % 64 + 1, i % 64), F.get(o, F.floor(i / 64).cast("int")), combine))

    df = once(df, **{f"{new}_v": F.transform(c, lambda x: value(x).cast("bigint")) for c, new in names.items()})
    df = once(df, **{f"{new}_r": runs(f"{new}_v") for new in names.values()})
    df = once(df, **{f"{new}_o": earlier(f"{new}_r") for new in names.values()})
    df = once(df, **{new: each(f"{new}_v", f"{new}_o") for new in names.values()})
    return df.drop(*[f"{new}_{x}" for new in names.values() for x in "vro"])


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _parts(text: Column, pattern: str, needed: Column) -> Column:
    """The text cut around all matches, which are the elements at odd places."""
    return F.when(needed, F.split(F.regexp_replace(text, f"({pattern})", f"{_CUT}$1{_CUT}"), _CUT, -1)).otherwise(F.array(F.lit("")))


def _matches(parts: str, starts: str, kind: int) -> Column:
    """Spans of the matches, from the parts of a text and where they start."""
    def span(x: Column, i: Column) -> Column:
        at = F.get(starts, i)
        return F.when(i % 2 == 1, F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.char_length(x)).alias("end"), x.alias("text"),
                                           F.right(F.get(parts, i - 1), F.lit(40)).alias("before")))

    return F.array_compact(F.transform(parts, span))


def _numbered(docs: DataFrame) -> dict[str, str]:
    """A working name for every column, so that none clashes with the columns of this module."""
    return {c: f"_c{i}" for i, c in enumerate(docs.columns)}


def _candidates(docs: DataFrame, text: str) -> DataFrame:
    """The document's columns under numbers, ``base`` spans, and ``more`` candidates that overlap none of them."""
    names = _numbered(docs)
    plain = F.coalesce(F.col(names[text]), F.lit(""))
    held = once(docs.toDF(*names.values()), _t=F.when(plain.rlike(_FOREIGN), F.regexp_replace(plain, _FOREIGN, "\uf8ff")).otherwise(plain))
    t = F.col("_t")
    any_digit = t.rlike("[0-9]")
    dotted = F.regexp_replace(t, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    joined = F.regexp_replace(t, r"(?<=[0-9])[ -](?=[0-9])", _GAP)
    cut = once(
        held,
        _p0=_parts(dotted, _EMAIL, t.contains("@")), _p1=_parts(t, _IP, any_digit),
        _p2=_parts(joined, _CARD, t.rlike("[0-9][0-9 -]{14}")), _p3=_parts(t, _PHONE, t.contains("+")),
        _p4=_parts(t, _MORE, F.lit(True)))
    placed = _before(cut, {f"_p{i}": f"_s{i}" for i in range(5)}, F.char_length, lambda a, b: a + b)
    found = once(placed, **{name: _matches(f"_p{i}", f"_s{i}", i) for i, name in enumerate(("_email", "_ip", "_card", "_phone", "_more"))})
    ip = F.filter("_ip", lambda s: F.forall(F.split(s["text"], r"\."), lambda x: x.cast("double") <= 255))
    card = F.filter("_card", lambda s: F.char_length(_digits(s["text"])).between(16, 19) & _luhn(_digits(s["text"])))
    phone = F.filter("_phone", lambda s: F.char_length(_digits(s["text"])).between(8, 15))
    kept = once(found, base=F.concat("_email", ip, card, phone))
    # base spans and candidates in one order of places; candidates do not overlap each other, so a base span that begins inside one is the next in order
    def in_order(c: str, more: int) -> Column:
        return F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(more).alias("more"), x["end"].alias("end"), x.alias("s")))

    both = F.array_sort(F.concat(in_order("base", 0), in_order("_more", 1)))
    kept = _before(once(kept, _both=both), {"_both": "_far"}, lambda x: F.when(x["more"] == 0, x["end"]).otherwise(F.lit(0)), _larger)

    def alone(x: Column, i: Column) -> Column:
        following = F.get("_both", i + 1)
        inside = following.isNotNull() & (following["more"] == 0) & (following["start"] < x["end"])
        return F.when((x["more"] == 1) & (F.get("_far", i) <= x["start"]) & ~F.coalesce(inside, F.lit(False)), x["s"])

    free = F.array_compact(F.transform("_both", alone))

    def kind(m: Column) -> Column:
        c = F.lit(KINDS.index("secret"))
        for name, pattern in reversed(_MORE_KIND):
            c = F.when(m["text"].rlike(pattern), F.lit(KINDS.index(name))).otherwise(c)
        return c

    more = F.transform(free, lambda m: F.struct(kind(m).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
                                                m["text"].alias("text"), m["before"].alias("before")))
    return once(kept, more=more).select(*names.values(), "base", "more")


def _votes(s: Column) -> Column:
    """What each labeler says of a span: 1 for, -1 against, 0 abstains; and the classifier's other features."""
    k, text = s["kind"], F.replace(s["text"], F.lit(_DOT), F.lit("."))
    is_ = lambda name: k == KINDS.index(name)
    yes = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(-1))
    mixed = text.rlike(r"[0-9]") & text.rlike("[A-Za-z]{2}")
    shape = (F.when(k < len(BASE_KINDS), F.lit(1)).when(is_("secret"), yes(mixed))
             .when(is_("national_id"), yes(~text.rlike("^(?:000|666|9)")))
             .when(is_("local_phone"), yes(text.rlike(r"^\([2-9]"))).when(is_("iban"), yes(F.char_length(F.replace(text, F.lit(" "), F.lit(""))).between(15, 34)))
             .otherwise(F.lit(0)))
    gazetteer = (F.when(is_("email"), yes(F.lower(text).rlike(rf"\.(?:{_TLDS})$")))
                 .when(is_("card"), yes(text.rlike("^(?:4|5[1-5]|3[47]|6)")))
                 .when(is_("phone"), yes(text.rlike(r"^\+[1-9]")))
                 .when(is_("secret"), F.when(text.rlike("^(?:AKIA|ASIA)"), F.lit(1)).otherwise(F.lit(0)))
                 .when(is_("person"), F.when(text.rlike(rf"\b(?:{_FIRST_NAMES})\b"), F.lit(1)).otherwise(F.lit(0)))
                 .when(is_("iban"), F.lit(1)).otherwise(F.lit(0)))
    context = F.when(s["before"].rlike(_CONTEXT) | text.rlike(r"^(?i)(?:password|passwd|secret|token|api[_-]?key|dr\.|mr|ms|prof)"), F.lit(1)).otherwise(F.lit(0))
    against = F.when(s["before"].rlike(_AGAINST), F.lit(-1)).otherwise(F.lit(0))
    placeholder = F.when(F.lower(text).rlike(r"changeme|xxxx|placeholder|(.)\1{7}|12345678"), F.lit(-1)).otherwise(F.lit(0))
    n, d = F.char_length(text), F.char_length(_digits(text))
    length = F.when(n < 12, 0).when(n < 20, 1).when(n < 40, 2).otherwise(3)
    digits = F.when(d == 0, 0).when(d * 2 < n, 1).otherwise(2)
    return F.struct(k.alias("kind"), shape.alias("shape"), gazetteer.alias("gazetteer"), context.alias("context"),
                    against.alias("against"), placeholder.alias("placeholder"), length.alias("length"), digits.alias("digits"))


def expectation_maximisation(votes: np.ndarray, kinds: np.ndarray, counts: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Probability that each pattern of votes is personal data, from reliabilities estimated without labels.

    Every labeler has, for either class, a distribution over its three answers; every kind has
    its own share of true spans.  Starts from the sum of the votes; a prior of a tenth of the spans says that
    labelers are better than chance, without which unanimous votes leave the classes unnamed.
    """
    q = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    prior = 0.1 * counts.sum()
    for _ in range(rounds):
        log_odds = np.zeros(len(q))
        for k in np.unique(kinds):
            at = kinds == k
            share = ((counts[at] * q[at]).sum() + 2) / (counts[at].sum() + 4)
            log_odds[at] = np.log(share / (1 - share))
        for j in range(votes.shape[1]):
            for v, good, bad in ((-1, 0.1, 0.4), (0, 0.5, 0.5), (1, 0.4, 0.1)):
                at = votes[:, j] == v
                p = ((counts[at] * q[at]).sum() + good * prior) / ((counts * q).sum() + prior)
                n = ((counts[at] * (1 - q[at])).sum() + bad * prior) / ((counts * (1 - q)).sum() + prior)
                log_odds[at] += np.log(p / n)
    q = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return q


@dataclass
class SpanClassifier:
    """Logistic weights by feature and value."""

    bias: float
    weights: dict[tuple[str, int], float]

    def accepts(self, v: Column) -> Column:
        score = F.lit(self.bias)
        for name in FEATURES:
            by_value = F.lit(0.0)
            for (f, value), w in self.weights.items():
                if f == name:
                    by_value = F.when(v[name] == value, F.lit(w)).otherwise(by_value)
            score = score + by_value
        return score > 0


def fit_classifier(patterns: list[tuple[tuple[int, ...], int]], steps: int = 400) -> SpanClassifier:
    """Logistic regression on the patterns of features, weighted by their counts, towards the EM probabilities.

    Without a pattern every labeler counts one vote.
    """
    if not patterns:
        return SpanClassifier(0.0, {(v, s): float(s) for v in VOTERS for s in (-1, 1)})
    x = np.array([p for p, _ in patterns])
    counts = np.array([n for _, n in patterns], float)
    q = expectation_maximisation(x[:, 1:1 + len(VOTERS)], x[:, 0], counts)
    columns = [(j, int(v)) for j in range(x.shape[1]) for v in np.unique(x[:, j])]
    m = np.stack([(x[:, j] == v) for j, v in columns], axis=1).astype(float)
    weight, w, b = np.sqrt(counts) / np.sqrt(counts).sum(), np.zeros(m.shape[1]), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(m @ w + b)))
        g = weight * (p - q)
        w -= 4.0 * (m.T @ g + 1e-4 * w)
        b -= 4.0 * g.sum()
    return SpanClassifier(float(b), {(FEATURES[j], v): float(a) for (j, v), a in zip(columns, w)})


def train_classifier(docs: DataFrame, text: str = "text") -> SpanClassifier:
    """Counts vote patterns of all candidates of all documents; only the patterns, at most some thousands, come to the driver."""
    spans = _candidates(docs.select(text), text).select(F.explode(F.concat("base", "more")).alias("s"))
    votes = once(spans, v=_votes(F.col("s"))).select(*[F.col("v")[f].alias(f) for f in FEATURES])
    counted = votes.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    return fit_classifier(sorted((tuple(int(r[f]) for f in FEATURES), int(r["n"])) for r in counted))


def find_spans(docs: DataFrame, text: str = "text", classifier: SpanClassifier | None = None) -> DataFrame:
    """``row`` (a struct of the document's columns, so no name can clash) and ``spans`` of every document.

    A span is (kind, start, end, text) in code points, end exclusive, ordered by kind and start.  Base spans
    are found by pattern and always stay; further candidates stay if the classifier accepts them.  The classifier
    is trained on the same documents unless one is given.

    Null and empty texts have no spans; repeated rows and null identifiers are treated like others; an empty
    table gives an empty result.  No row is shuffled and a text is never cut.
    """
    names = _numbered(docs)
    row = F.struct(*[F.col(n).alias(c) for c, n in names.items()])
    return _found(docs, text, classifier).select(row.alias("row"), "spans")


def _found(docs: DataFrame, text: str, classifier: SpanClassifier | None) -> DataFrame:
    judge = classifier or train_classifier(docs, text)
    more = F.filter("more", lambda s: judge.accepts(_votes(s)))
    plain = lambda a: F.transform(a, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.regexp_replace(F.replace(s["text"], F.lit(_DOT), F.lit(".")), _GAP, " ").alias("text")))
    return _candidates(docs, text).select(*_numbered(docs).values(), F.array_sort(F.concat(plain(F.col("base")), plain(more))).alias("spans"))


def kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one mark.

    ``n_chars``, where there is one, follows the text; columns as they come; null texts stay null.
    """
    names = _numbered(docs)
    found = _found(docs, "text", None)
    source = F.col(names["text"])
    found = once(found, _ordered=F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))

    placed = _before(found, {"_ordered": "_at"}, lambda s: s["end"], _larger)
    # what stays before each mark, and behind the last one (without a kind); a span that begins inside an earlier one has no mark
    gaps = F.array_compact(F.transform("_ordered", lambda s, i: F.when(s["start"] >= F.get("_at", i), F.struct(
        F.get("_at", i).alias("start"), s["start"].alias("end"), s["kind"].alias("kind")))))
    last = F.greatest(F.element_at("_at", -1), F.element_at("_ordered", -1)["end"])
    rest = F.struct(last.alias("start"), F.char_length(source).cast("bigint").alias("end"), F.lit(None).cast("int").alias("kind"))
    gaps = F.when(F.size("_ordered") > 0, F.concat(gaps, F.array(rest))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>"))
    # the text in blocks, as a place is found by walking from the start of its string
    cut = once(placed, _gaps=gaps, _blocks=F.regexp_extract_all(source, F.lit(f"(?s).{{1,{_BLOCK}}}+"), F.lit(0)))

    def part(g: Column) -> Column:
        a, b = F.floor(g["start"] / _BLOCK).cast("int"), F.floor(g["end"] / _BLOCK).cast("int")
        block = lambda i: F.coalesce(F.get("_blocks", i), F.lit(""))
        head, stop = (g["start"] % _BLOCK + 1).cast("int"), (g["end"] % _BLOCK).cast("int")
        return F.when(a == b, F.substring(block(a), head, (g["end"] - g["start"]).cast("int"))).otherwise(F.concat(
            F.substring(block(a), head, F.lit(_BLOCK)), F.array_join(F.slice("_blocks", a + 2, b - a - 1), ""), F.substring(block(b), F.lit(1), stop)))

    rewritten = F.array_join(F.transform("_gaps", lambda g: F.when(g["kind"].isNull(), part(g)).otherwise(
        F.concat(part(g), F.lit("["), F.upper(kind_name(g["kind"])), F.lit("]")))), "")
    changed = once(cut, _text=F.when(F.size("_gaps") > 1, rewritten).otherwise(source))
    columns = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("bigint")}
    return changed.select(*[columns.get(c, F.col(n)).alias(c) for c, n in names.items()])
