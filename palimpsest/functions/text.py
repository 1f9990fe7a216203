"""Word-level string columns: splitting, orthographic normalisation, spelling keys, sameness keys.

Everything here is a built-in column expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, the same character class in Java and RE2 syntax.
WS = (
    r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)

# Spelling variants folded in this order before two words are compared.
VARIANT_FOLDS = (
    ("th", "t"),
    ("ph", "p"),
    ("ch", "c"),
    ("rh", "r"),
    ("y", "i"),
    ("ngue", "nge"),
    ("np", "mp"),
    ("nb", "mb"),
)
ENCLITICS = ("que", "ue", "ne")
# Archaic superlative endings and their classical form.
ARCHAIC_ENDINGS = (
    ("umus", "imus"),
    ("uma", "ima"),
    ("umum", "imum"),
    ("umis", "imis"),
    ("umae", "imae"),
    ("umo", "imo"),
)

# Function words that never count as shared content.
STOP_WORDS = tuple(
    """
    et in ad ab ex de cum non ut si sed aut atque ac vel nec neque quod quia quae qui quam quo qua
    est sunt esse erat erant sit sint fuit erit enim autem nam tamen iam tum tunc hic haec hoc ille
    illa illud ipse ipsa ipsum is ea id ego tu nos vos me te se sui sibi suus sua suum meus tuus
    noster vester per pro sub super inter ante post contra sine ob propter apud etiam quoque quidem
    vero nunc omnis omnes omnia unus una unum duo tres magnus magna magnum bonus bona bonum multus
    multa multum quis quid quem cuius cui ne an num utrum dum donec quando ubi unde ibi inde ergo
    igitur itaque
    """.split()
)


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(accented, base) strings for ``translate``: every letter whose decomposition is one base
    letter followed by combining marks. Built from the Unicode data, not listed."""
    accented, base = [], []
    for code in list(range(0xC0, 0x250)) + list(range(0x370, 0x530)) + list(range(0x1E00, 0x2000)):
        ch = chr(code)
        stripped = "".join(
            c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c)
        )
        if stripped != ch and len(stripped) == 1:
            accented.append(ch)
            base.append(stripped)
    return "".join(accented), "".join(base)


def words(text: Column) -> Column:
    """Whitespace words of a text; punctuation stays attached."""
    return F.filter(F.split(text, WS), lambda w: w != "")


def squeeze(text: Column) -> Column:
    """The text with every run of white space as one blank."""
    return F.trim(F.regexp_replace(text, WS, " "))


def _replace(col: Column, old: str, new: str) -> Column:
    return F.replace(col, F.lit(old), F.lit(new))


def strip_accents(col: Column) -> Column:
    accented, base = accent_table()
    return F.regexp_replace(F.translate(col, accented, base), r"\p{Mn}", "")


def normalize(col: Column, *, lowercase: bool = True, fold_ij_uv: bool = True) -> Column:
    """The form two words are compared in."""
    out = strip_accents(col)
    if lowercase:
        out = F.lower(out)
    if fold_ij_uv:
        out = F.translate(out, "jv", "iu")
    for old, new in VARIANT_FOLDS:
        out = _replace(out, old, new)
    return F.regexp_replace(out, r"[^\p{L}\p{N}_]", "")


def spelling_key(col: Column) -> Column:
    """One key per class of orthographic variants; inflection stays visible."""
    key = F.regexp_replace(F.translate(F.lower(col), "vj", "ui"), "[^0-9a-z]", "")
    key = _drop_enclitic(key)
    for old, new in (("ae", "e"), ("oe", "e"), ("y", "i"), ("mpt", "nt"), ("cq", "q"), ("dq", "q"),
                     ("gue", "ge"), ("ph", "f"), ("h", "")):
        key = _replace(key, old, new)
    key = F.regexp_replace(key, r"(.)\1", "$1")
    for pattern, new in (("d$", "t"), ("ns$", "s"), ("nst", "st"), ("ens$", "es"), ("n$", "m")):
        key = F.regexp_replace(key, pattern, new)
    return key


def _drop_enclitic(col: Column) -> Column:
    """Strip the first matching enclitic that leaves at least three characters."""
    return F.regexp_replace(col, "^(.{3,}?)(?:" + "|".join(ENCLITICS) + ")$", "$1")


def extended(norm: Column) -> Column:
    """Wider sameness on a normalised form: oe as ae, archaic superlatives as classical ones."""
    endings = "|".join(old[2:] for old, _ in ARCHAIC_ENDINGS)
    return F.regexp_replace(_replace(norm, "oe", "ae"), f"um({endings})$", "im$1")


def strip_enclitic(col: Column) -> Column:
    return _drop_enclitic(col)


def plural(col: Column) -> Column:
    return F.regexp_replace(col, "[ie]s$", "es")


SAMENESS = ("current", "+folds", "+enclitic", "+plural")


def same(policy: str, norm_a: Column, norm_b: Column) -> Column:
    """Whether two normalised words count as one word under a policy."""
    if policy == "current":
        return norm_a == norm_b
    a, b = extended(norm_a), extended(norm_b)
    if policy == "+folds":
        return a == b
    sa, sb = strip_enclitic(a), strip_enclitic(b)
    if policy == "+enclitic":
        return (a == b) | (sa == sb)
    if policy == "+plural":
        return (a == b) | (sa == sb) | (plural(sa) == plural(sb))
    raise ValueError(f"unknown sameness policy {policy!r}; expected one of {SAMENESS}")


def content_tokens(text: Column) -> Column:
    """The distinct content words of a blank-separated text: four letters or more, no function word.

    The whole text is folded by one pass of each function, then split, so no expression runs per word
    but the length and stop-word test.
    """
    letters = F.regexp_replace(F.translate(F.lower(text), "vj", "ui"), "[^a-z ]", "")
    kept = F.filter(F.split(letters, " "), lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(kept)


def lemma_standin(norm: Column) -> Column:
    """A stand-in lemma where no lemma table exists: the first five letters; NULL when shorter than three."""
    return F.when(F.length(norm) >= 3, F.left(norm, F.lit(5)))


def pos_standin(lemma: Column) -> Column:
    """A stand-in part of speech read off the lemma's last letter."""
    last = F.right(lemma, F.lit(1))
    return (
        F.when(last.isin("e", "t", "r"), "v").when(last.isin("s", "d", "n"), "n").when(
            lemma.isNotNull(), "a"
        )
    )


def capitalised(word: Column) -> Column:
    """Whether the first Latin letter of a word is a capital."""
    return F.regexp_replace(word, "^[^A-Za-z]+", "").rlike("^[A-Z]")


def ends_clause(word: Column) -> Column:
    return word.rlike(r"[.;:?!]$")


def draw(*parts: Column | str | int) -> Column:
    """A reproducible sort key: the md5 of the parts joined by a bar. Stands for a seeded shuffle."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def unit_draw(*parts: Column | str | int) -> Column:
    """A reproducible number in [0, 1) from 32 bits of ``draw``."""
    return F.conv(F.left(draw(*parts), F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def bucket_draw(n: int, *parts: Column | str | int) -> Column:
    """A reproducible whole number in [0, n)."""
    return F.conv(F.left(draw(*parts), F.lit(6)), 16, 10).cast("int") % F.lit(n)
