"""Label spaces, their collapses, costs and spellings, as column expressions over literal maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Op, V0, V1, group.
LABEL_ROWS = (
    ("COPY", "KEEP", "COPY", "form"),
    ("MORPH", "REPLACE", "MORPH", "form"),
    ("SYN", "REPLACE", "SUBST", "lexical-semantic"),
    ("POS", "REPLACE", "SUBST", "lexical-semantic"),
    ("NE-SUB", "REPLACE", "SUBST", "lexical-semantic"),
    ("SUBST", "REPLACE", "SUBST", "lexical-semantic"),
    ("SPLIT", "REPLACE", "SUBST", "cardinality"),
    ("MERGE", "REPLACE", "SUBST", "cardinality"),
    ("REORDER", "KEEP", "COPY", "structural"),
    ("FRAME", "INS", "INS", "structural"),
    ("QUOTE", "KEEP", "COPY", "structural"),
    ("DISPERSE", "REPLACE", "SUBST", "structural"),
    ("INS", "INS", "INS", "residual"),
    ("DEL", "DEL", "DEL", "residual"),
)
# Mode of a group (structural operations are told apart by name).
GROUP_MODE = {"form": "VERBATIM", "lexical-semantic": "ALLUSION", "cardinality": "ALLUSION", "residual": "NOMATCH"}
# Old spellings; a demoted relation stays as detail, ADAPT is dropped.
ALIASES = {
    "NOP": "COPY", "SYN-DIST": "SYN", "HYPER": "SUBST", "HYPO": "SUBST", "ANT": "SUBST", "CO-HYPO": "SUBST",
    "FORM": "MORPH", "SENSE": "SUBST", "LINK": "SUBST",
}
DROPPED = ("ADAPT",)
DEMOTED = ("HYPER", "HYPO", "ANT", "CO-HYPO", "SYN-DIST")
LEXICAL_DETAILS = {
    "SUBST": ("HYPER", "HYPO", "CO-HYPO", "ANT", "META", "NUM", "PRON", "FUNC", "CONSTR"),
    "SYN": ("SYN-DIST",),
}
MORPH_FEATURES = ("CASE", "NUMBER", "GENDER", "TENSE", "MOOD", "PERSON", "VOICE", "DEGREE")
INFLECTABLE = ("MORPH", "SYN", "POS", "NE-SUB", "SUBST")

# Tag, cost, role (w writes, c consumes, m marks), inverse.
OPERATION_ROWS = (
    ("NOP", 0.0, "w", "NOP"), ("MORPH", 0.25, "w", "MORPH"), ("SYN", 0.5, "w", "SYN"),
    ("HYPER", 0.75, "w", "HYPO"), ("HYPO", 0.75, "w", "HYPER"), ("ANT", 1.0, "w", "ANT"),
    ("SYN-DIST", 0.6, "w", "SYN-DIST"), ("NE-SUB", 0.75, "w", "NE-SUB"), ("SUBST", 0.8, "w", "SUBST"),
    ("POS", 0.5, "w", "POS"), ("FORM", 0.562, "w", "FORM"), ("SENSE", 0.725, "w", "SENSE"),
    ("INS", 1.0, "w", "DEL"), ("DEL", 1.0, "c", "INS"), ("REORDER", 0.5, "m", "REORDER"),
    ("SPLIT", 0.75, "w", "MERGE"), ("MERGE", 0.75, "w", "SPLIT"), ("QUOTE", 0.0, "w", "QUOTE"),
    ("FRAME", 0.5, "w", "FRAME"), ("ADAPT", 0.0, "m", "ADAPT"), ("DISPERSE", 1.5, "m", "DISPERSE"),
)
# Released label and relation of a code tag.
RELEASED = {"NOP": "COPY", "COPY": "COPY", "MORPH": "INFLECT", "INFLECT": "INFLECT", "SUBST": "SUBST", "SPLIT": "SPLIT", "MERGE": "MERGE"}
RELATION_TAGS = ("SYN", "SYN-DIST", "HYPER", "HYPO", "CO-HYPO", "ANT", "POS", "NE-SUB", "FUNC", "META", "CONSTR", "PRON", "NUM")

LEVELS = ("V0", "V1", "mode", "group", "V3")
_TABLES = {
    "V0": {r[0]: r[1] for r in LABEL_ROWS},
    "V1": {r[0]: r[2] for r in LABEL_ROWS},
    "group": {r[0]: r[3] for r in LABEL_ROWS},
    "V3": {r[0]: r[0] for r in LABEL_ROWS},
    "mode": {
        r[0]: "FRAME" if r[0] == "FRAME" else ("VERBATIM" if r[0] in ("REORDER", "QUOTE") else GROUP_MODE.get(r[3], "ALLUSION"))
        for r in LABEL_ROWS
    },
    "cost": {r[0]: r[1] for r in OPERATION_ROWS},
    "role": {r[0]: r[2] for r in OPERATION_ROWS},
    "inverse": {r[0]: r[3] for r in OPERATION_ROWS},
    "released": RELEASED,
    "alias": ALIASES,
}


def lookup(table: str, key: Column) -> Column:
    """The value of ``key`` in a fixed table, NULL when absent: a literal map, so no join."""
    return F.create_map(*[F.lit(x) for kv in _TABLES[table].items() for x in kv])[key]


def canonical_op(tag: Column) -> Column:
    return F.when(tag.isNull() | (tag == "") | tag.isin(*DROPPED), F.lit(None)).otherwise(
        F.coalesce(lookup("alias", tag), tag)
    )


def canonical_detail(tag: Column) -> Column:
    return F.when(tag.isin(*DEMOTED), tag).otherwise(F.lit(""))


def collapse(level: str, op: Column, in_frame: Column) -> Column:
    """``op`` at a level; an unlinked word inside a citing formula reads as the formula."""
    framed = in_frame & (op == "INS")
    base = lookup(level, op)
    if level == "V3":
        return F.when(framed, "FRAME").otherwise(base)
    if level == "group":
        return F.when(framed, "structural").otherwise(base)
    if level == "mode":
        return F.when(in_frame, "FRAME").otherwise(base)
    return base


def released_label(tag: Column) -> Column:
    return F.coalesce(lookup("released", tag), F.when(tag.isin(*RELATION_TAGS), "SUBST"))


def released_relation(tag: Column) -> Column:
    return F.when(tag == "POS", "DERIV").when(tag.isin(*RELATION_TAGS), tag)


def detail_parts(detail: Column) -> Column:
    return F.filter(F.transform(F.split(detail, r"\+"), lambda p: F.upper(F.trim(p))), lambda p: p != "")


def normalise_detail(op: Column, detail: Column) -> Column:
    """The detail in its fixed order: one lexical value, then inflection features; anything outside the
    closed list is returned unchanged."""
    parts = detail_parts(detail)
    allowed = F.create_map(
        *[x for o, v in LEXICAL_DETAILS.items() for x in (F.lit(o), F.array(*[F.lit(i) for i in v]))]
    )
    mine = F.coalesce(allowed[op], F.array().cast("array<string>"))
    lexical = F.filter(parts, lambda p: F.array_contains(mine, p))
    feats = F.array(*[F.lit(f) for f in MORPH_FEATURES])
    morph = F.filter(parts, lambda p: F.array_contains(feats, p))
    ordered = F.filter(feats, lambda f: F.array_contains(morph, f))
    bad = (
        (F.size(lexical) > 1)
        | (F.size(lexical) + F.size(morph) < F.size(parts))
        | ((F.size(morph) > 0) & ~op.isin(*INFLECTABLE))
        | (F.size(morph) != F.size(F.array_distinct(morph)))
    )
    return (
        F.when(detail.isNull() | (detail == ""), "")
        .when(op == "MERGE", detail)
        .when(bad, detail)
        .otherwise(F.array_join(F.concat(lexical, ordered), "+"))
    )


def detail_error(op: Column, detail: Column) -> Column:
    """Whether a detail is outside the closed list of its operation."""
    parts = detail_parts(detail)
    allowed = F.create_map(
        *[x for o, v in LEXICAL_DETAILS.items() for x in (F.lit(o), F.array(*[F.lit(i) for i in v]))]
    )
    mine = F.coalesce(allowed[op], F.array().cast("array<string>"))
    feats = F.array(*[F.lit(f) for f in MORPH_FEATURES])
    lexical = F.filter(parts, lambda p: F.array_contains(mine, p))
    morph = F.filter(parts, lambda p: F.array_contains(feats, p))
    bad = (
        (F.size(lexical) > 1)
        | (F.size(lexical) + F.size(morph) < F.size(parts))
        | ((F.size(morph) > 0) & ~op.isin(*INFLECTABLE))
        | (F.size(morph) != F.size(F.array_distinct(morph)))
    )
    return (
        F.when(detail.isNull() | (detail == ""), False)
        .when(op == "MERGE", ~detail.rlike(r"^\+[0-9]+$"))
        .otherwise(bad)
    )


def to_paper_op(op: Column) -> Column:
    return F.when(op == "MORPH", "INFLECT").when(op.isin("SYN", "POS", "NE-SUB"), "SUBST").otherwise(op)


def to_paper_detail(op: Column, detail: Column, *, revised: bool = False) -> Column:
    norm = normalise_detail(op, detail)
    relation = F.when(op == "POS", "DERIV").otherwise(op) if revised else op
    return (
        F.when((op == "SYN") & norm.rlike(r"^SYN-DIST(\+|$)"), norm)
        .when(op.isin("SYN", "POS", "NE-SUB"), F.concat_ws("+", relation, F.when(norm != "", norm)))
        .otherwise(norm)
    )


def from_paper_op(op: Column, detail: Column) -> Column:
    head = F.get(detail_parts(F.coalesce(detail, F.lit(""))), F.lit(0))
    code = F.when(head == "DERIV", "POS").otherwise(head)
    return (
        F.when(op == "INFLECT", "MORPH")
        .when((op == "SUBST") & head.isin("SYN", "POS", "NE-SUB", "DERIV"), code)
        .when((op == "SUBST") & (head == "SYN-DIST"), "SYN")
        .otherwise(op)
    )


def from_paper_detail(op: Column, detail: Column) -> Column:
    text = F.coalesce(detail, F.lit(""))
    parts = detail_parts(text)
    head = F.get(parts, F.lit(0))
    code = from_paper_op(op, detail)
    rest = F.when(
        (op == "SUBST") & head.isin("SYN", "POS", "NE-SUB", "DERIV"),
        F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "+"),
    ).otherwise(text)
    return normalise_detail(code, rest)
