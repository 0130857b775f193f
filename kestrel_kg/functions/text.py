"""Column functions on labels and texts. Patterns are Unicode-aware and run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a label.
LABEL_STOP_WORDS = ("a", "an", "and", "by", "for", "in", "of", "on", "or", "the", "to", "with", "в", "и", "или", "при", "с", "у")
# Words that carry no meaning in a claim.
CLAIM_STOP_WORDS = ("the", "and", "for", "with", "как", "что", "при", "для", "или", "это", "по", "на", "в", "и")
# Search patterns and the words they add to a text.
SYNONYM_RULES = (
    (r"\bостр\w*\s+лимфобластн\w*\s+лейкоз\w*\b|\bолл\b", ("олл", "острый лимфобластный лейкоз", "лимфобластный лейкоз", "all", "acute lymphoblastic leukemia")),
    (r"\bb\s*[- ]?\s*олл\b|\bв\s*[- ]?\s*олл\b|\bb\s*cell\s+all\b", ("в олл", "в-олл", "b-олл", "b cell acute lymphoblastic leukemia")),
    (r"\bt\s*[- ]?\s*олл\b|\bt\s*cell\s+all\b", ("t олл", "t-олл", "t cell acute lymphoblastic leukemia")),
    (r"\bbcr\s+abl\b|\bbcrabl\b|\bbcr\s+abl1\b", ("bcr-abl", "bcr::abl", "bcr::abl1", "bcr abl", "филадельфийская хромосома")),
    (r"\bph\+\b|ph\s*позитивн\w*|филадельфийск\w*", ("ph+", "ph positive", "ph-позитивный", "филадельфийская хромосома", "bcr-abl")),
    (r"\bингибитор\w*\s+тирозинкиназ\w*\b|\bтки\b|tyrosine\s+kinase", ("тки", "ингибиторы тирозинкиназы", "ингибитор тирозинкиназы", "tyrosine kinase inhibitor", "bcr-abl")),
    (r"\bлеч\w*\b|\bтерап\w*\b|\btreat\w*\b", ("лечение", "терапия", "химиотерапия", "протокол лечения", "treats")),
    (
        r"\bтгск\b|\bткм\b|трансплантац\w*\s+костн\w*\s+мозг\w*|трансплантац\w*\s+гемопоэтическ\w*",
        ("тгск", "ткм", "трансплантация костного мозга", "трансплантация гемопоэтических стволовых клеток"),
    ),
)
# Disclaimers that are cut from answers.
DISCLAIMERS = (
    r"\s*Обратите внимание,\s*что\s+это\s+не\s+является\s+медицинской\s+консультацией\.?",
    r"\s*Это\s+не\s+медицинская\s+рекомендация\.?",
    r"\s*Это\s+не\s+является\s+медицинской\s+консультацией\.?",
    r"\s*This\s+is\s+not\s+medical\s+advice\.?",
)

# Spellings of clinical names that labels and searches treat alike, and what replaces them.
LABEL_SPELLINGS = ((r"(?i)\bbcr\s*(?:::|[-/\\]|\s)\s*abl\s*1?\b", "bcr abl"), (r"\bph\s*\+\b", "ph positive"), (r"\bph\s*-\b", "ph negative"))
SEARCH_SPELLINGS = (
    (r"\bbcr\s*(?:::|[-/\\]|\s)\s*abl\s*1?\b", " bcr abl bcrabl bcr-abl bcr-abl1 "), (r"\bbcr\s*(?:::|[-/\\])\s*abl", " bcr abl bcrabl bcr-abl "),
    (r"\bph\s*\+\b", " ph+ ph positive "), (r"\bph\s*-\b", " ph- ph negative "),
)
# What stands in parentheses as another name, and what is left out as a remark.
INSIDE, REMARK = r"\(([^()]{2,18})\)", r"\([^()]+\)"

SPACES = r"(?U)[\s\x1c-\x1f]+"


def re_sub(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, f"(?U){pattern}", by)


def words(text: Column) -> Column:
    """Words between Unicode white space and the separators U+001C to U+001F."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def strip(text: Column) -> Column:
    return re_sub(text, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def fold(text: Column) -> Column:
    """Case folding for the languages in use: lower case, sharp s as ss."""
    return F.regexp_replace(F.lower(text), "ß", "ss")


def casefold(text: Column) -> Column:
    """Full Unicode case folding, for texts that ``fold`` doesn't cover."""
    return F.pandas_udf(casefolded, "string")(text)


def casefolded(text: pd.Series) -> pd.Series:
    return text.str.casefold()


def normalize_label(label: Column) -> Column:
    """Strip, lower, one space for white space, none before and one after ``, . ; :``."""
    out = re_sub(F.lower(strip(label)), r"\s+", " ")
    return re_sub(re_sub(out, r"\s+([,.;:])", "$1"), r"([,.;:])(?=\S)", "$1 ")


def entity_id(label: Column) -> Column:
    return F.md5(normalize_label(label))


def normalize_eval_label(label: Column) -> Column:
    return F.regexp_replace(normalize_label(label), "ё", "е")


def canonical_text(label: Column) -> Column:
    """Normal form for duplicate detection. It isn't idempotent, and callers apply it as often as they mean to."""
    out = F.regexp_replace(normalize_label(label), "ё", "е")
    for pattern, by in LABEL_SPELLINGS:
        out = re_sub(out, pattern, by)
    out = re_sub(F.replace(out, F.lit("::"), F.lit(" ")), r"[^\w+]+", " ")
    return strip(re_sub(out, r"\s+", " "))


def distinct_canonical(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, canonical_text), lambda v: v != ""))


def label_variants(label: Column) -> Column:
    """The label, what stands in its parentheses (2 to 18 characters), and the label without parentheses."""
    inside = F.regexp_extract_all(label, F.lit(INSIDE), F.lit(1))
    outside = F.regexp_replace(label, REMARK, " ")
    return distinct_canonical(F.transform(F.concat(F.array(label), inside, F.array(outside)), canonical_text))


def entity_variants(label: Column, aliases: Column) -> Column:
    every = F.concat(F.array(label), F.coalesce(aliases, F.array().cast("array<string>")))
    return distinct_canonical(F.flatten(F.transform(every, label_variants)))


def label_tokens(label: Column) -> Column:
    return F.regexp_extract_all(normalize_label(label), F.lit("[a-zа-яё0-9]+"), F.lit(0))


def without(tokens: Column, stop: Iterable[str]) -> Column:
    return F.array_except(tokens, F.array(*[F.lit(w) for w in stop]))


def blocking_tokens(label: Column) -> Column:
    return without(F.array_distinct(label_tokens(label)), LABEL_STOP_WORDS)


def blocking_keys(label: Column, aliases: Column) -> Column:
    """Tokens of every variant, and every variant as a whole."""
    variants = entity_variants(label, aliases)
    return F.array_union(F.flatten(F.transform(variants, blocking_tokens)), F.transform(variants, lambda v: F.concat(F.lit("exact:"), v)))


def search_text(text: Column, folded: Column | None = None) -> Column:
    out = F.regexp_replace(fold(text) if folded is None else folded, "ё", "е")
    for pattern, by in SEARCH_SPELLINGS:
        out = re_sub(out, pattern, by)
    return strip(re_sub(re_sub(out, r"[^\w+]+", " "), r"\s+", " "))


def search_tokens(text: Column) -> Column:
    return F.regexp_extract_all(search_text(text), F.lit(r"[a-zа-я0-9]+\+?"), F.lit(0))


def expand(text: Column, rules: Iterable[tuple[str, Iterable[str]]] = SYNONYM_RULES) -> Column:
    """``text`` followed by the words of every rule that its normal form matches."""
    form = search_text(text)
    return F.concat_ws(" ", text, *[F.when(form.rlike(f"(?U){pattern}"), F.lit(" ".join(added))) for pattern, added in rules])


def entity_document(label: Column, kind: Column, description: Column, aliases: Column) -> Column:
    joined = F.array_join(F.coalesce(aliases, F.array().cast("array<string>")), " ")
    parts = [F.nullif(x, F.lit("")) for x in (label, label, kind, description, joined, joined)]
    return expand(F.concat_ws(" ", *parts))


def content_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(normalize_eval_label(text), F.lit(r"[a-zа-я0-9]+\+?"), F.lit(0))
    return F.filter(without(F.array_distinct(found), CLAIM_STOP_WORDS), lambda t: F.length(t) > 1)


def is_cyrillic(text: Column) -> Column:
    return text.rlike("[а-яёА-ЯЁ]")


def without_disclaimers(answer: Column) -> Column:
    for pattern in DISCLAIMERS:
        answer = re_sub(answer, f"(?iu){pattern}", "")
    return strip(F.regexp_replace(answer, r"\n{3,}", "\n\n"))


def entity_line(label: Column, kind: Column, description: Column, aliases: Column) -> Column:
    about = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(": "), description)).otherwise("")
    also = F.when(F.size(F.coalesce(aliases, F.array().cast("array<string>"))) > 0, F.concat(F.lit(" Aliases: "), F.array_join(aliases, ", "))).otherwise("")
    return F.rtrim(F.concat(F.lit("- "), label, F.lit(" ["), kind, F.lit("]"), about, F.lit("."), also))


def relation_line(subject: Column, predicate: Column, object_: Column, confidence: Column) -> Column:
    return F.format_string("- %s --%s--> %s (confidence=%.2f)", subject, predicate, object_, confidence)


def relationship_type(predicate: Column) -> Column:
    """A name that graph stores take: capitals, letters, digits and underscores."""
    out = F.regexp_replace(re_sub(F.upper(strip(predicate)), r"\W+", "_"), "^_+|_+$", "")
    return F.when(out == "", "RELATED_TO").when(~out.rlike(r"(?U)^\p{Alpha}"), F.concat(F.lit("REL_"), out)).otherwise(out)


def document_id(path: Column) -> Column:
    """An id from a relative path: folders joined, suffix dropped, other characters as underscores."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), "/", "__")
    out = F.regexp_replace(re_sub(fold(bare), r"\W+", "_"), "^_+|_+$", "")
    return F.when(out == "", "document").otherwise(out)


def plain_filename(name: Column) -> Column:
    """Base name of an upload, with the suffix .md."""
    base = F.regexp_replace(strip(name), r"^.*[/\\]", "")
    base = F.when(base == "", "document").otherwise(base)
    return F.when(F.lower(base).endswith(".md"), base).otherwise(F.concat(base, F.lit(".md")))
