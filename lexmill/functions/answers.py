"""Prompts, message lists, model output: citations, their validation, the safety net and flags, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker of a refusal, the citation form, and labels of the answer format.
UNKNOWN = "BAĞLAMDA YOK"
CITATION = r"\[\s*([A-ZÇĞİÖŞÜ]{2,6})\s*m\.?\s*((?:GEÇİCİ|EK)?\s*\d+(?:/[A-Za-zÇĞİÖŞÜçğıöşü])?)\s*[^\]]*\]"
GROUNDS_LINE = r"(?imd)^[ \t]*\**[ \t]*dayanak[ \t]*\**[ \t]*:[ \t]*\**(.*)$\n?"
ANSWER_LABEL = r"(?im)^\s*\**\s*cevap\s*\**\s*:\s*\**\s*"
COPIED_HEADING = r"^\[[^\]]{3,60}\](?:\s*(?:[IVXLC]+|\d+|[A-ZÇĞİÖŞÜ])\s*[.)]\s*[^\n]{0,60})?\s*$"
ORNAMENT = r"(?iu)^\s*(\*\*)?\s*(özet|özetle|sonuç|yanıt)\s*(\*\*)?\s*:\s*(\*\*)?\s*"

SYSTEM_PROMPT = f"Answer only from the articles in the context. Write the labels of the articles used, then at most four sentences. If they do not suffice, write {UNKNOWN}."
RELEVANT = "CONTEXT ({n} articles):\n{context}\n\nQUESTION: {question}"
IRRELEVANT = "No article is close enough to this question.\n\nQUESTION: {question}\n\nDo not answer it; write {unknown}. Articles found, for information only:\n{context}"
NOTHING = "(no article found)"
SAMPLE = ("CONTEXT (1 articles):\n[ABC m. 1] I. General\nA thing kept is returned whole.\n\nQUESTION: In what state is a kept thing returned?", "DAYANAK: [ABC m. 1]\nCEVAP: It is returned whole.")


def _fill(template: str, **values: Column) -> Column:
    """The template with its fields replaced; values are not searched for fields again."""
    parts, rest = [], template
    while rest:
        at = min((rest.find(f"{{{k}}}") for k in values if f"{{{k}}}" in rest), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = rest[at + 1 : rest.index("}", at)]
        parts += [F.lit(rest[:at]), values[name].cast("string")]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def context_block(label: Column, heading: Column, note: Column, text: Column) -> Column:
    """One article as the prompt shows it: [label] heading (note), then its text."""
    head = F.concat(F.lit("["), label, F.lit("]"), F.when(heading != "", F.concat(F.lit(" "), heading)).otherwise(""), F.when(note != "", F.concat(F.lit(" ("), note, F.lit(")"))).otherwise(""))
    return F.concat(head, F.lit("\n"), text)


def build_messages(question: Column, blocks: Column, relevant: Column) -> Column:
    """Messages for the model; the worked example only for questions in scope."""
    context = F.when(F.size(blocks) == 0, F.lit(NOTHING)).otherwise(F.array_join(blocks, "\n\n"))
    asked = F.trim(question)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    system = message("system", F.lit(SYSTEM_PROMPT))
    yes = F.array(system, message("user", F.lit(SAMPLE[0])), message("assistant", F.lit(SAMPLE[1])), message("user", _fill(RELEVANT, n=F.size(blocks), context=context, question=asked)))
    no = F.array(system, message("user", _fill(IRRELEVANT, question=asked, unknown=F.lit(UNKNOWN), context=context)))
    return F.when(relevant, yes).otherwise(no)


def add_suffix(messages: Column, suffix: str = "/no_think") -> Column:
    """User messages that lack the suffix get it."""
    return F.transform(
        messages,
        lambda m: F.struct(m["role"].alias("role"), F.when((m["role"] == "user") & ~F.contains(m["content"], F.lit(suffix)), F.concat(F.rtrim(m["content"]), F.lit(f" {suffix}"))).otherwise(m["content"]).alias("content")),
    )


def fold_system(messages: Column) -> Column:
    """System messages moved into the first user message, parted by a rule; alone they become a user message."""
    system = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n\n")
    rest = F.filter(messages, lambda m: m["role"] != "system")
    first = F.array_position(F.transform(rest, lambda m: m["role"]), "user")
    user = lambda content: F.struct(F.lit("user").alias("role"), content.alias("content"))
    placed = F.transform(rest, lambda m, i: F.when(i + 1 == first, user(F.concat(system, F.lit("\n\n---\n\n"), m["content"]))).otherwise(m))
    return F.when(system == "", rest).when(first == 0, F.concat(F.array(user(system)), rest)).otherwise(placed)


def extract_citations(text: Column) -> Column:
    """Citations of an answer in upper case with single spaces, each once, in order; one a bracket."""
    law, number = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(k)) for k in (1, 2))
    return F.array_distinct(F.zip_with(law, number, lambda a, n: F.concat(F.upper(a), F.lit(" m. "), F.upper(F.trim(F.regexp_replace(n, r"\s+", " "))))))


def clean_answer(text: Column) -> Column:
    """An answer without a copied context block or ornament; its grounds line goes to the end unless already there."""
    text = F.coalesce(text, F.lit(""))
    grounds = F.trim(F.regexp_extract(text, GROUNDS_LINE, 1))
    rest = F.when(text.rlike(GROUNDS_LINE), _without_first(text, GROUNDS_LINE)).otherwise(text)
    rest = F.when(rest.rlike(ANSWER_LABEL), _after_first(rest, ANSWER_LABEL)).otherwise(rest)
    lines = F.split(rest, "\n")
    state = F.struct(F.lit(True).alias("skipping"), F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, line: Column) -> Column:
        s = F.trim(line)
        heading = s.rlike(COPIED_HEADING) & ~s.rlike(r"[.!?]$")
        keep = ~a["skipping"] | ((s != "") & ~heading & ~a["inside"])
        inside = F.when(s == "", False).when(heading, True).otherwise(a["inside"])
        return F.struct((~keep).alias("skipping"), inside.alias("inside"), F.when(keep, F.concat(a["kept"], F.array(line))).otherwise(a["kept"]).alias("kept"))

    left = F.trim(F.array_join(F.aggregate(lines, state, step)["kept"], "\n"))
    left = F.when(left == "", _strip(rest)).otherwise(_strip(left))
    left = _strip(F.regexp_replace(left, ORNAMENT, ""))
    return F.when((grounds != "") & ~F.contains(left, grounds), _strip(F.concat(left, F.lit("\n\nDAYANAK: "), grounds))).otherwise(left)


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _after_first(text: Column, pattern: str) -> Column:
    """What follows the pattern's first match."""
    return F.substring(text, F.length(F.element_at(F.split(text, pattern, 2), 1)) + F.length(F.regexp_substr(text, F.lit(pattern))) + 1, F.length(text))


def _without_first(text: Column, pattern: str) -> Column:
    return F.concat(F.element_at(F.split(text, pattern, 2), 1), _after_first(text, pattern))


def is_unknown(text: Column) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(F.lit(UNKNOWN)))


def unsupported(citations: Column, shown: Column) -> Column:
    """Citations of what the model was not shown."""
    return F.array_except(citations, shown)


def safety_net(text: Column, citations: Column, labels: Column, in_scope: Column) -> Column:
    """An answer in scope, not a refusal and without citation, gets the labels of all that was shown."""
    marks = F.transform(labels, lambda x: F.concat(F.lit("["), x, F.lit("]")))
    missing = in_scope & ~is_unknown(text) & (F.size(citations) == 0) & (F.size(labels) > 0) & ~F.exists(marks, lambda m: F.contains(text, m))
    return F.when(missing, F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n\nDAYANAK: "), F.array_join(marks, ", "))).otherwise(text)


def is_trusted(citations: Column, unsupported_: Column, unknown: Column, in_scope: Column) -> Column:
    """No unsupported citation; out of scope only a refusal, in scope a refusal or a citation."""
    return F.when(F.size(unsupported_) > 0, False).when(~in_scope, unknown).otherwise(unknown | (F.size(citations) > 0))


def source_list(labels: Column, headings: Column) -> Column:
    return F.zip_with(labels, headings, lambda a, b: F.when(b == "", a).otherwise(F.concat(a, F.lit(" — "), b)))
