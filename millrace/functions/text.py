"""Names, phrases and token counts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that come in pairs, and words that cue evidence.
PAIRS = ["scissors", "skis"]
EVIDENCE_CUE = r"(?i)\b(evidence|visible|visually|see|seen|image|picture|photo|shown|because)\b"


def clean_name(name: Column) -> Column:
    """Lower-cased name of letters, digits, slashes and single spaces; ``_`` and ``-`` become spaces, all else is deleted."""
    plain = F.regexp_replace(F.translate(F.lower(name), "_-", "  "), "[^a-z0-9 /]+", "")
    return F.trim(F.regexp_replace(plain, " +", " "))


def cleaned_together(*names: Column, lists: tuple[Column, ...] = ()) -> list[Column]:
    """``clean_name`` of each name and of each list's names, null as an empty name; the first column is what to work out once.

    The others read it as ``_cleaned``. All are cleaned as one text, a name a line, so that patterns are run once a row; line
    feeds are deleted from names first, as cleaning does.
    """
    bare = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(""))
    text = F.lower(F.concat_ws("\n", *map(bare, names), *[F.transform(x, bare) for x in lists]))
    text = F.regexp_replace(F.regexp_replace(text, r"[^\w /\n-]+", ""), "[_-][_ -]*| [_ -]+", " ")
    out, begin = [F.coalesce(F.get("_cleaned", F.lit(i)), F.lit("")) for i in range(len(names))], F.lit(len(names) + 1)
    for x in lists:
        n = F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))
        out, begin = [*out, F.slice("_cleaned", begin, n)], begin + n
    return [F.split(F.trim(text), " ?\n ?"), *out]


def is_plural(name: Column) -> Column:
    """Whether a cleaned name ends in s, "bus" aside."""
    return F.endswith(name, F.lit("s")) & (name != "bus")


def article_phrase(name: Column) -> Column:
    """"a dog", "an apple", "cats", "a pair of skis"; the name is cleaned first."""
    name = clean_name(name)
    article = F.when(F.substring(name, 1, 1).isin(list("aeiou")), F.lit("an ")).otherwise(F.lit("a "))
    return F.when(name.isin(PAIRS), F.concat(F.lit("a pair of "), name)).when(is_plural(name), name).otherwise(F.concat(article, name))


def be_verb(name: Column) -> Column:
    return F.when(is_plural(clean_name(name)), "are").otherwise("is")


def filled(template: str, *parts: Column | str) -> Column:
    """A template whose %s are replaced in turn, null by "null": what format_string gives, without a formatter for each row."""
    said, *rest = template.split("%s")
    out = [F.lit(said)]
    for part, then in zip(parts, rest, strict=True):
        out += [F.coalesce(F.col(part) if isinstance(part, str) else part, F.lit("null")), F.lit(then)]
    return F.concat(*out)


def token_count(text: Column) -> Column:
    """Words and single punctuation marks; letters of any script belong to words' remainder as in Unicode."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9_]+|[^\p{L}\p{N}_\s]")).cast("long")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9']+")).cast("long")


def has_evidence_cue(text: Column) -> Column:
    return F.coalesce(text.rlike(EVIDENCE_CUE), F.lit(False))


def mentions(text: Column, name: Column) -> Column:
    """Whether the cleaned text has the cleaned name as whole words; an empty name is never mentioned."""
    text, name = (F.coalesce(clean_name(c), F.lit("")) for c in (text, name))
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (name != "") & F.contains(pad(text), pad(name))


def slug(name: Column) -> Column:
    return F.regexp_replace(clean_name(name), "[ /]+", "_")


def stem(path: Column) -> Column:
    """A path's last part without its suffix; a name that begins or ends with its only dot has none."""
    name = F.regexp_extract(path, "([^/]*)/*$", 1)
    return F.when(name.rlike(r"(?s)^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def canonical_image_id(file_name: Column, image_id: Column, prefix: str = "coco_train2017_") -> Column:
    """The prefix and the stem of the file name; without a name that of the number, in twelve digits."""
    return F.concat(F.lit(prefix), stem(F.coalesce(F.nullif(file_name, F.lit("")), F.format_string("%012d.jpg", image_id.cast("long")))))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def escape_md(text: Column) -> Column:
    """One line whose bars don't end a Markdown cell."""
    return F.replace(one_line(text), F.lit("|"), F.lit("\\|"))


def compact(text: Column, size: int = 180) -> Column:
    return F.substring(one_line(text), 1, size)


def candidate_evidence(prompt: Column) -> Column:
    """What a probe prompt names as candidate evidence."""
    return one_line(F.regexp_extract(F.coalesce(prompt, F.lit("")), r"Candidate evidence:\s*(.+)", 1))


def failure_category(claim: Column, subject: Column, obj: Column, relation: Column, support: Column) -> Column:
    """Why a relation probe was accepted, by what its claim, evidence and predicted support say."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    claim, subject, obj = low(claim), low(subject), low(obj)
    swapped = (subject != "") & (obj != "") & (F.position(obj, claim) > 0) & (F.position(subject, claim) > 0) & (F.position(obj, claim) < F.position(subject, claim))
    copied = F.coalesce(support, F.lit("")) == "supported"
    return (
        F.when(swapped, "subject/object swap").when(copied, "copied candidate evidence without verification")
        .when(F.coalesce(relation, F.lit("")).isin("left_of", "right_of"), "left/right ambiguity").otherwise("candidate relation text under-specified")
    )


def percent(value: float) -> str:
    """A share as a percentage with one decimal."""
    return f"{100 * float(value) + 1e-9:.1f}"


def interval(mean: float, low: float, high: float) -> str:
    return f"{percent(mean)} [{percent(low)}, {percent(high)}]"


def percent_or_pending(value: float | None, nudged: bool = False, sign: str = "") -> str:
    """A share as a percentage with one decimal and ``sign`` behind it; "pending" where there is none."""
    if value is None:
        return "pending"
    return percent(value) if nudged else f"{100 * float(value):.1f}{sign}"


def delta(value: float) -> str:
    """A difference of shares in percentage points, with its sign."""
    return f"{100 * value:+.1f}"


def csv_value(value):
    """A value as a CSV report has it: nothing for none, six decimals for fractions."""
    return "" if value is None else f"{value:.6f}" if isinstance(value, float) else value
