"""Personal data: weak supervision. Labelers vote on candidate spans, expectation-maximisation finds their reliabilities,
and a span classifier trained on the posteriors decides on the spans beyond the base patterns.

All of it is DataFrame expressions; what reaches the driver is one row per kind, vote pattern and features, whose number
is bounded by the labelers and features and not by the data.

Candidates are wide: any long mix of letters and digits, any long number, any date, any run like an account code. Four
labelers vote yes or no on each, or abstain: the pattern labeler (formats of personal data and formats of something
else), the gazetteer (tables of issuers, calling codes and countries), the context labeler (cue words among the CONTEXT
characters before, for personal data or for order numbers, versions and the like) and the form labeler (checksums and
the mix of characters). Reliabilities are shared by all kinds, base spans included, and each kind has its own share of
true spans; so a kind that shows few votes is judged by what its labelers proved to be elsewhere.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.columns import let

# The base kinds and their patterns. Possessive forms and the look-behinds match the same spans as
# email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+),
# card [0-9]([\x20-]?[0-9])+ and phone \+[0-9][\x20().0-9-]+[0-9], in time linear in the text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap necessary conditions, so that most texts skip the pattern.
NEEDS = {"email": "@", "phone": "+"}
# Patterns of candidates beyond the base kinds.
EXTRA = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,64}[0-9])(?=[0-9_-]{0,64}[A-Za-z])[A-Za-z0-9_-]{12,128}(?![A-Za-z0-9_-])",
    "national_phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "account": r"(?<![A-Za-z0-9.+_-])[0-9](?:[\x20-]?[0-9]){7,18}(?![A-Za-z0-9_-])",
    "birth_date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][./][01]?[0-9][./](?:19|20)[0-9]{2})(?![0-9./-])",
}
# What the pattern labeler takes for personal data, and for something else.
STRICT = {
    "secret": r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?:sk|pk|rk)[-_][A-Za-z0-9_-]{16,64})$",
    "national_phone": r"^(?:\([0-9]{3}\)\x20|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?:[0-9]{11,26}|[A-Z]{4}[0-9]{10,18}|(?:\x20[A-Z0-9]{4}){3,6}(?:\x20[A-Z0-9]{1,3})?)$",
    "email": r"^[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}$",
    "ip": r"^(?!0+\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})$",
    "phone": r"^\+[1-9][0-9]{0,2}[\x20-]?(?:\([0-9]{2,4}\)|[0-9])[\x200-9-]+$",
}
OTHER = {
    "secret": r"(?i)^(?:[a-z]+[-_]?)*(?:version|release|chapter|section|figure|table|build|v)[-_]?[0-9][0-9a-z_-]*$|^[a-z]+(?:[-_][a-z]+)+[-_]?[0-9]{1,4}$|^[0-9]+(?:st|nd|rd|th|px|em|ms|kb|mb|gb)$",
    "account": r"^(?:19|20)[0-9]{2}[01][0-9][0-3][0-9](?:[0-9]{6})?$|^[0-9]{1,3}(?:\x20[0-9]{3})+$|^(.)\1+$",
    "national_phone": r"^000|^(?:\(?111|\(?123)",
}
# The gazetteers, as beginnings of a span, or endings of an address.
ISSUERS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_", "sk-", "pk_", "rk_", "xoxb", "xoxp", "AIza", "ya29", "eyJ")
CALLING_CODES = ("+1", "+31", "+32", "+33", "+34", "+351", "+39", "+41", "+43", "+44", "+45", "+46", "+47", "+48", "+49", "+52", "+54", "+55", "+61", "+7", "+81", "+86", "+90", "+91")
IBAN_COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE", "TR")
MAIL_ENDINGS = (".com", ".org", ".net", ".edu", ".gov", ".info", ".de", ".fr", ".es", ".it", ".nl", ".uk", ".eu", ".io", ".at", ".ch", ".tr")
CARD_STARTS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
UNROUTED = ("0.", "127.", "255.", "10.", "192.168.")
# Cue words before a span, for the kind and against it.
CUES = {
    "secret": r"(?i)(?:passw(?:or)?d|passwort|contraseña|mot\x20de\x20passe|passwd|secret|token|api.?key|key|auth|bearer|credential)s?[\"']?\s*(?:[=:]|is)?\s*[\"']?$",
    "national_phone": r"(?i)(?:tel|phone|call|fax|mobile|telefon|t[ée]l[ée]fono?)\b",
    "national_id": r"(?i)(?:ssn|social|security|id|tax)\b",
    "iban": r"(?i)(?:iban|account|konto|compte|cuenta|transfer|überweisung)\b",
    "account": r"(?i)(?:account|acct|konto|compte|cuenta|passport|licen[cs]e\x20no|customer|member|insurance|card|visa|karte|carte|tarjeta)\b",
    "birth_date": r"(?i)(?:born|birth|birthday|dob|geboren|geburtsdatum|née?|naissance|nacid[oa]|nacimiento)\b",
    "email": r"(?i)(?:mail|contact|write|kontakt|correo|courriel)\b",
    "ip": r"(?i)(?:ip|host|server|address|from)\b",
    "card": r"(?i)(?:card|visa|karte|carte|tarjeta|credit)\b",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|telefon|t[ée]l[ée]fono?)\b",
}
COUNTER_CUES = r"(?i)(?:sha-?[0-9]{0,3}|md5|checksum|hash|commit|revision|build|version|release|order|invoice|isbn|issn|doi|page|pages|chapter|section|figure|article|updated|published|copyright|since|model|serial|ticket|bestellung|commande|pedido)(?:\x20(?:no|number|nr|id))?\.?[\x20:#=-]*$"
CONTEXT = 32
LABELERS = ("pattern", "gazetteer", "context", "form")
KINDS = (*BASE, *EXTRA)
#: A labeler's vote is 0 for no, 1 for abstaining and 2 for yes; a span's votes are these as digits to base 3.
NO, ABSTAIN, YES = 0, 1, 2
#: The classifier's features of a span beside its kind and votes, and how many values each has.
FEATURES = {"length": 4, "digits": 3, "case": 3, "before": 3}
#: Candidates beyond the base are spans from this probability on.
ACCEPT = 0.5
EM_ROUNDS, FIT_STEPS = 60, 400
SPAN = "array<struct<rank:int,kind:string,start:int,end:int,base:boolean,votes:int,features:int>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits of ``match`` pass the Luhn sum."""
    figures = F.filter(F.split(F.reverse(_digits(match)), ""), lambda c: c != "")
    worth = F.transform(figures, lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(worth, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern is a span."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), luhn(m)).otherwise(False)
    return F.length(_digits(m)).between(9, 15) if kind == "phone" else F.lit(True)


def iban_sum(m: Column) -> Column:
    """Whether the first four characters put last, letters as two figures, leave 1 by 97."""
    code = F.regexp_replace(m, r"\x20", "")
    figures = F.filter(F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), ""), lambda c: c != "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(figures, F.lit(0), step) == 1


def _starts(table: tuple[str, ...]) -> str:
    return "^(?:" + "|".join(re.escape(x) for x in table) + ")"


def _ends(table: tuple[str, ...]) -> str:
    return "(?i)(?:" + "|".join(re.escape(x) for x in table) + ")$"


#: Of the gazetteer and form labelers, patterns for and against each kind; checksums and counts are added in _ballot.
KNOWN = {
    "secret": (_starts(ISSUERS), None),
    "phone": (_starts(CALLING_CODES), r"^\+0"),
    "iban": (_starts(IBAN_COUNTRIES), f"^(?!{_starts(IBAN_COUNTRIES)[1:]})"),
    "email": (_ends(MAIL_ENDINGS), None),
    "card": (_starts(CARD_STARTS), None),
    "account": (None, _starts(CARD_STARTS)),
    "ip": (f"^(?!{_starts(UNROUTED)[1:]})", _starts(UNROUTED)),
    "national_phone": (r"555|^\(?8(?:00|88|77|66)", None),
}
MISSHAPEN = {
    "secret": r"[_-]{2}|([A-Za-z0-9])\1{3}",
    "national_phone": r"([0-9])\1{5}",
    "national_id": r"([0-9])\1{5}",
    "birth_date": r"-(?:00|1[3-9])-|-(?:00|3[2-9])$|^(?:0?0|3[2-9])[./]|[./](?:0?0|1[3-9])[./]|20[3-9][0-9]$|^20[3-9]",
}
#: Digests in hexadecimal figures of 32, 40 and 64 places.
DIGEST = "^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"


def _vote(m: Column, yes: str | Column | None, no: str | Column | None) -> Column:
    """A labeler's vote from what speaks for and what against: a pattern, a condition, or nothing."""
    out = None
    for test, vote in ((yes, YES), (no, NO)):
        if test is not None:
            holds = m.rlike(test) if isinstance(test, str) else test
            out = F.when(holds, vote) if out is None else out.when(holds, vote)
    return F.lit(ABSTAIN) if out is None else out.otherwise(ABSTAIN)


def _ballot(kind: str, m: Column, before: Column) -> list[Column]:
    """The four labelers' votes on one candidate."""
    if kind == "secret":
        digits, n = F.length(_digits(m)) * 8, F.length(m)
        mixed = digits.between(n, n * 7)
        # digests are as random as keys, whatever they repeat, and a word may end in a number: their form says nothing
        shaped = _vote(m, mixed & ~m.rlike(MISSHAPEN[kind] + "|^[a-z]+[_-]|^[a-z]{4,}[0-9]+[a-z]*$"), ~mixed | m.rlike(MISSHAPEN[kind]))
        form = F.when(m.rlike(DIGEST), ABSTAIN).otherwise(shaped)
    elif kind == "account":
        form = _vote(m, None, F.length(_digits(m)).between(13, 19))  # of a card's length, but the sum is wrong
    elif kind == "iban":
        form = F.when(iban_sum(m), YES).otherwise(NO)
    elif kind in MISSHAPEN:
        form = _vote(m, None, MISSHAPEN[kind])
    else:
        form = F.lit(YES)  # base spans are valid already
    context = F.when(before.rlike(CUES[kind]), YES).when(before.rlike(COUNTER_CUES), NO).otherwise(ABSTAIN)
    return [_vote(m, STRICT.get(kind), OTHER.get(kind)), _vote(m, *KNOWN.get(kind, (None, None))), context, form]


def _features(m: Column, before: Column) -> Column:
    """The features of a candidate as one number, by the places and sizes of FEATURES."""
    digits, n = F.length(_digits(m)), F.length(m)
    upper, lower = m.rlike("[A-Z]"), m.rlike("[a-z]")
    values = {
        "length": F.least(F.lit(3), F.floor(n / 12).cast("int")),
        "digits": F.when(digits * 4 <= n, 0).when(digits * 4 <= 3 * n, 1).otherwise(2),
        "case": F.when(upper & lower, 2).when(upper, 1).otherwise(0),
        "before": F.when(before.rlike(r"""[=:"']\s*$"""), 2).when(before.rlike(r"[A-Za-z]\s*$"), 1).otherwise(0),
    }
    code = F.lit(0)
    for name, size in FEATURES.items():
        code = code * size + values[name]
    return code.cast("int")


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """Candidate spans of one kind. Places come from the gaps that a split at the same matches leaves."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if need := NEEDS.get(kind):
        matches = F.when(F.contains(text, F.lit(need)), matches).otherwise(F.array().cast("array<string>"))
    empty = F.array().cast(SPAN)
    rank, base = KINDS.index(kind), kind in BASE

    def before(start: Column) -> Column:
        return F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))

    def judged(m: Column, start: Column) -> Column:
        """Votes and features of one candidate; its context is cut once."""
        code = lambda said: F.struct(sum((v * 3**k for k, v in enumerate(_ballot(kind, m, said))), F.lit(0)).alias("votes"), _features(m, said).alias("features"))
        return let(before(start), code)

    def located(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(found, let(gaps, lambda g: F.slice(g, 1, F.size(found))), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,s:int>>").alias("out"))
        walk = F.aggregate(
            steps,
            zero,
            lambda a, x: F.struct((a["at"] + x["g"] + F.length(x["m"])).alias("at"), F.concat(a["out"], F.array(F.struct(x["m"].alias("m"), (a["at"] + x["g"]).alias("s")))).alias("out")),
        )
        kept = F.filter(walk["out"], lambda x: _valid(kind, x["m"])) if kind in BASE else walk["out"]
        seen = F.transform(kept, lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), judged(x["m"], x["s"]).alias("j")))
        span = lambda x: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), F.lit(base).alias("base"), x["j"]["votes"], x["j"]["features"])
        return F.transform(seen, span).cast(SPAN)

    return let(matches, lambda m: F.when(F.size(m) > 0, located(m)).otherwise(empty))


def _apart(extra: Column, taken: Column) -> Column:
    """The spans of ``extra`` that overlap none of ``taken``."""
    return let(taken, lambda t: F.when((F.size(t) == 0) | (F.size(extra) == 0), extra).otherwise(F.filter(extra, lambda x: ~F.exists(t, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, spans): each row of docs as a struct, so that no name can clash, and the candidate spans of its text.

    Base spans come first; a candidate that overlaps a base span or one of an earlier kind is left out. Null text: none.
    """
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", text.alias("text"))
    own = own.withColumn("digit", F.exists(F.array("text"), lambda x: x.rlike("[0-9]")))
    none = F.array().cast(SPAN)
    parts = [F.when(F.col("digit") | F.lit(k == "email"), _spans(F.col("text"), k, p)).otherwise(none).alias(k) for k, p in (BASE | EXTRA).items()]

    def settled(spans: Column, kinds: list[str]) -> Column:
        return let(F.concat(spans, _apart(F.col(kinds[0]), spans)), lambda x: settled(x, kinds[1:])) if kinds else spans

    return own.select("row", *parts).select("row", let(F.concat(*BASE), lambda x: settled(x, list(EXTRA))).alias("spans"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): the base spans and the candidates that overlap none of them. Null text: none."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return scan(own).select("row.doc_id", "spans")


@dataclass
class SpanModel:
    """Per labeler the rates of (no, yes) on true and on other spans, each kind's share of true spans, and the classifier's weights."""

    rates: list[tuple[list[float], list[float]]]
    share: dict[str, float]
    weights: dict[tuple[str, int], float]

    def logit(self, span: Column) -> Column:
        z = F.lit(0.0)
        for (name, value), w in self.weights.items():
            if name == "kind":
                holds = span["kind"] == KINDS[value]
            elif name in FEATURES:
                holds = _place(span["features"], name) == value
            else:
                holds = F.floor(span["votes"] / 3 ** LABELERS.index(name)) % 3 == value
            z = z + F.when(holds, float(w)).otherwise(0.0)
        return z


def _place(code, name: str):
    """The value of one feature in the number that _features makes."""
    names = list(FEATURES)
    below = math.prod(FEATURES[x] for x in names[names.index(name) + 1 :])
    return (code // below if isinstance(code, int) else F.floor(code / below)) % FEATURES[name]


#: What a labeler is taken for before any span is seen, as so many votes (no, yes) on true and on other spans.
PRIOR = ((1.0, 4.0), (4.0, 1.0))


def em(counts: dict[tuple[str, int], int]) -> tuple[list[tuple[list[float], list[float]]], dict[str, float], dict[tuple[str, int], float]]:
    """Two-class expectation-maximisation over votes, counts by (kind, votes). An abstention says nothing.

    A labeler's rates are learned from spans on which another one votes too: where it is alone there is nothing to hold
    it against, and its own votes would only confirm or refute themselves.

    Returns per labeler the rates of (no, yes) among its votes on true and on other spans, each kind's share of true spans,
    and the posterior of every (kind, votes). Base kinds are true by contract and anchor the rates.
    """
    ballots = {key: [key[1] // 3**k % 3 for k in range(len(LABELERS))] for key in counts}
    base = sum(n for (kind, _), n in counts.items() if kind in BASE)
    # base spans count as no more than all other candidates together, or they alone would make the rates
    scale = min(1.0, (sum(counts.values()) - base) / base) if base else 1.0
    rates = [tuple([x / sum(p) for x in p] for p in PRIOR) for _ in LABELERS]
    share = {kind: 0.5 for kind, _ in counts}
    posterior: dict[tuple[str, int], float] = {}
    for _ in range(EM_ROUNDS):
        for key, ballot in ballots.items():
            z = math.log(share[key[0]]) - math.log(1 - share[key[0]])
            z += sum(math.log(rates[k][0][v // YES]) - math.log(rates[k][1][v // YES]) for k, v in enumerate(ballot) if v != ABSTAIN)
            posterior[key] = 1.0 if key[0] in BASE else 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))
        for kind in share:
            own = [(n, posterior[key]) for key, n in counts.items() if key[0] == kind]
            share[kind] = (sum(n * p for n, p in own) + 2) / (sum(n for n, _ in own) + 4)
        tally = [(list(PRIOR[0]), list(PRIOR[1])) for _ in LABELERS]
        for key, ballot in ballots.items():
            if sum(v != ABSTAIN for v in ballot) < 2:
                continue
            n = counts[key] * (scale if key[0] in BASE else 1.0)
            for k, v in enumerate(ballot):
                if v != ABSTAIN:
                    tally[k][0][v // YES] += n * posterior[key]
                    tally[k][1][v // YES] += n * (1 - posterior[key])
        rates = [tuple([x / sum(votes) for x in votes] for votes in t) for t in tally]
    return rates, share, posterior


def fit(spans: DataFrame) -> SpanModel:
    """EM over the vote patterns, then logistic regression of the posteriors on kind, votes and features, weighted by counts.

    ``spans`` is read once, so it should be a table and not an expression. No span: a model without weights.
    """
    each = spans.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.features").count().collect()  # bounded by kinds x votes x features
    each = sorted((r.kind, r.votes, r.features, r["count"]) for r in each)
    counts: dict[tuple[str, int], int] = defaultdict(int)
    for kind, votes, _, n in each:
        counts[kind, votes] += n
    rates, share, posterior = em(counts)
    rows, names = [], {}
    for kind, votes, code, n in each:
        on = [("kind", KINDS.index(kind)), *((x, votes // 3**k % 3) for k, x in enumerate(LABELERS)), *((x, _place(code, x)) for x in FEATURES)]
        rows.append(([names.setdefault(x, len(names)) for x in on], posterior[kind, votes], math.log1p(n)))
    w = [0.0] * len(names)
    total = sum(n for *_, n in rows) or 1.0
    for _ in range(FIT_STEPS):
        step = [-0.002 * x for x in w]
        for on, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in on)))))
            for i in on:
                step[i] += n * (y - p) / total
        w = [x + 2.0 * s for x, s in zip(w, step)]
    return SpanModel(rates, share, dict(zip(names, w)))


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["rank"], s["start"], s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def decide(spans: DataFrame, model: SpanModel) -> DataFrame:
    """(doc_id, found): base spans, and the candidates that the classifier accepts."""
    return spans.select("doc_id", accepted(F.col("spans"), model).alias("found"))


def accepted(spans: Column, model: SpanModel) -> Column:
    cut = math.log(ACCEPT / (1 - ACCEPT))
    return F.filter(spans, lambda s: s["base"] | (model.logit(s) >= cut))


def mask(seen: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """The rows of ``scan`` with every found span of the text replaced by its kind in brackets; a null text stays null."""
    columns = seen.schema["row"].dataType.names
    text = F.col("row").getField(text_col).cast("string")
    out = seen.select("row", F.when(text.isNotNull(), masked(text, accepted(F.col("spans"), model))).alias("text"))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row of ``decide``.

    No span: zero counts, the hash of the empty string, an empty string. Repeated rows and null ids stay as they are.
    """
    base = F.filter("found", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of overlapping spans the first by place counts."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(piece)).alias("out")))

    done = F.aggregate(order, zero, step)
    return F.when(F.size(spans) == 0, text).otherwise(let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text)))))
