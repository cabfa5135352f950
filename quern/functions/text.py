"""Functions on text, JSON and arrays. All are Column -> Column; those marked (Arrow) run vectorised Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Trailing legal forms of company names, in the order in which they are tried.
LEGAL_SUFFIXES = [
    "limited liability company", "public limited company", "societe a responsabilite limitee", "sp z o o", "naamloze vennootschap", "besloten vennootschap", "b v b a",
    "incorporated", "corporation", "company", "limited", "s l u", "b v", "n v", "s a r l", "s a s", "s p a", "s r l", "s a", "s r o", "s l", "a s", "p c", "s c", "o ü",
    "p t e", "p t y", "l l c", "l l p", "p l c", "g m b h", "inc", "corp", "ltd", "llc", "llp", "plc", "gmbh", "sarl", "sas", "spa", "srl", "sa", "sro", "slu", "oü", "ou",
    "pte", "pty", "kft", "ag", "bv", "nv", "oy", "ab", "as", "aps", "lp", "co",
]
# The shorter list that registries use.
REGISTRY_SUFFIXES = ["b v", "bv", "corp", "corporation", "inc", "incorporated", "limited", "llc", "ltd", "n v", "nv", "plc"]
# Parts of the names of personal fields.
PERSONAL_MARKERS = ["employee", "staff", "team_member", "founder", "owner", "ceo", "director", "personal_email", "personal_phone", "contact_person", "email", "mobile", "phone", "telephone"]
# Country markers, in the order in which they are tried.
COUNTRY_MARKERS = [
    ("the netherlands", "Netherlands"), ("netherlands", "Netherlands"), ("nederland", "Netherlands"), ("united kingdom", "United Kingdom"), ("great britain", "United Kingdom"),
    ("united states", "United States"), ("duitsland", "Germany"), ("germany", "Germany"), ("belgië", "Belgium"), ("belgie", "Belgium"), ("belgium", "Belgium"), ("frankrijk", "France"), ("france", "France"),
]
# Words left out of summaries, and of topics.
SUMMARY_STOPWORDS = ["a", "an", "and", "are", "as", "at", "based", "by", "company", "for", "from", "in", "is", "of", "on", "provides", "the", "their", "to", "with"]
TOPIC_STOPWORDS = ["a", "agencies", "agency", "and", "business", "businesses", "companies", "company", "firms", "for", "in", "of", "providers", "the"]
# Words of business names, and words that name no company.
BUSINESS_WORDS = ["agency", "bureau", "bv", "commerce", "company", "consulting", "collective", "corp", "corporation", "digital", "group", "inc", "labs", "llc", "ltd", "network", "partners", "studio", "solutions", "technologies"]
GENERIC_WORDS = ["about", "agency", "commerce", "company", "contact", "digital", "ecommerce", "expertise", "home", "services", "solutions", "specialists", "welcome"]

#: Words of page labels; a text that begins with one names a page.
PAGE_LABELS = ["about", "contact", "diensten", "expertise", "home", "oplossingen", "services", "solutions", "welcome"]
FILLERS = ["our", "team", "we"]

EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(^|[^\p{L}\p{N}_])(\+?\d[\d().\s-]{6,}\d)"
WORD = r"[\p{L}\p{N}]+"


def compact(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_field_name(c: Column) -> Column:
    """Lower case, other than a-z and 0-9 as _, none at the ends; null if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out != "", out)


def normalized_text(c: Column) -> Column:
    return compact(F.replace(F.lower(c), F.lit("-"), F.lit(" ")))


def _without_suffixes(c: Column, suffixes: list[str]) -> Column:
    """Trailing tokens of the list gone, again and again. One alternation does it: which of two suffixes goes first does not matter, as all that end the name go."""
    out = F.regexp_replace(F.concat(F.lit(" "), c), "( (" + "|".join(suffixes) + "))+$", "")
    return F.trim(out)


def normalize_company_name(c: Column) -> Column:
    """Lower case, & as and, other than letters and digits as blanks, legal forms at the end gone; null if nothing is left."""
    clean = F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "))
    out = _without_suffixes(clean, LEGAL_SUFFIXES)
    return F.when(out != "", out)


def registry_name(c: Column) -> Column:
    """Other than letters and digits as blanks, one legal form of registries at the end gone; may be empty."""
    clean = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), clean), " (" + "|".join(REGISTRY_SUFFIXES) + ")$", ""))


def redact(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, EMAIL, "[redacted]"), PHONE, "$1[redacted]")


def compact_fragment(c: Column, limit: int = 500) -> Column:
    return F.substring(redact(compact(c)), 1, limit)


def contains_contact(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL) | c.rlike(PHONE), F.lit(False))


def is_personal_field(name: Column) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in PERSONAL_MARKERS]), lambda m: F.contains(name, m))


def looks_like_person_name(c: Column) -> Column:
    """Two to four words, each a capital and letters or a particle, none of a business."""
    words = F.split(compact(c), " ")
    named = F.forall(words, lambda w: w.rlike(r"^\p{Lu}[\p{L}'-]*$") | w.isin("van", "de", "der", "den", "von", "da", "di", "la", "le"))
    business = F.arrays_overlap(F.transform(words, F.lower), F.array(*[F.lit(w) for w in BUSINESS_WORDS]))
    return F.size(words).between(2, 4) & named & ~business


def plausible_company_name(c: Column) -> Column:
    """Neither blank, of generic words alone, a page's label, with contact data, nor a person's name."""
    words = F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)
    generic = F.size(F.array_except(words, F.array(*[F.lit(w) for w in GENERIC_WORDS + FILLERS]))) == 0
    label = F.coalesce(F.get(words, F.lit(0)).isin(PAGE_LABELS), F.lit(False))
    return (F.size(words) > 0) & ~generic & ~label & ~contains_contact(c) & ~looks_like_person_name(c)


def country_from_text(c: Column) -> Column:
    low = F.lower(c)
    return F.coalesce(*[F.when(low.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){m}($|[^\p{{L}}\p{{N}}_])"), F.lit(name)) for m, name in COUNTRY_MARKERS])


def content_tokens(c: Column) -> Column:
    """Distinct word tokens of two characters and more, without stop words, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(WORD), 0), lambda w: (F.length(w) > 1) & ~w.isin(SUMMARY_STOPWORDS))))


def topic_terms(topic: Column, location: Column) -> Column:
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit(WORD), 0)
    return F.array_distinct(F.filter(F.array_except(words(topic), words(location)), lambda w: ~w.isin(TOPIC_STOPWORDS)))


def truncate_text(c: Column, limit: int) -> Column:
    """At most limit characters, back to the last blank or newline if that keeps four fifths, no white space at the end."""
    cut = F.substring(c, 1, limit)
    back = F.regexp_replace(cut, "[ \n][^ \n]*\\z", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.regexp_replace(F.when((F.length(back) < F.length(cut)) & (F.length(back) >= int(limit * 0.8)), back).otherwise(cut), r"\s+\z", ""))


def string_list(values: Column, limit: int = 300) -> Column:
    """Distinct strings (first spelling of each, whatever its case) of at most limit characters without contact data."""
    ok = F.filter(F.transform(values, compact), lambda v: (v != "") & (F.length(v) <= limit) & ~contains_contact(v))
    return F.filter(ok, lambda v, i: F.array_position(F.transform(ok, F.lower), F.lower(v)) == i + 1)


def json_key(values: Column) -> Column:
    """A text equal for arrays that hold the same strings whatever their case and order."""
    return F.to_json(F.array_sort(F.transform(values, F.lower)))


def round_ratio(points: int, part: Column, whole: Column) -> Column:
    """points * part / whole, half up, in integers."""
    return F.expr("1") * ((F.lit(2 * points) * part + whole) - ((F.lit(2 * points) * part + whole) % (whole * 2))) / (whole * 2)


def sparql_string(c: Column) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for a, b in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


# Parts of the names of secret settings.
SECRET_MARKERS = ["api_key", "apikey", "authorization", "password", "secret", "token"]


def redact_secrets(fields: Column) -> Column:
    """A map with the values of secret names replaced."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).rlike("|".join(SECRET_MARKERS)), F.lit("[redacted]")).otherwise(v))


def normalized_place(c: Column) -> Column:
    return F.regexp_replace(compact(F.lower(c)), "^the ", "")


def wikidata_id(c: Column) -> Column:
    """Q and digits, bare or from a /entity/ or /wiki/ url; null if invalid."""
    v = F.trim(c)
    bare = F.when(F.contains(v, F.lit("://")), F.regexp_extract(v, r"(?i)^https?://(?:www\.)?wikidata\.org/(?:entity|wiki)/(q\d+)/?$", 1)).otherwise(F.regexp_extract(v, r"(?i)^(q\d+)$", 1))
    return F.when(bare != "", F.upper(bare))


def registry_id(c: Column) -> Column:
    """jurisdiction/number in lower case, bare or from a url with companies/; null if invalid."""
    v = F.trim(c)
    part = F.when(F.contains(v, F.lit("://")), F.regexp_extract(v, r"(?i)^https?://(?:www\.|api\.)?opencorporates\.com/(?:.*?)companies/([^?#]*)", 1)).otherwise(v)
    out = F.lower(F.regexp_replace(F.regexp_replace(part, r"\s+", ""), "^/+|/+$", ""))
    return F.when(out.rlike("^[a-z0-9]+(_[a-z0-9]+)*/[^/]{1,300}$"), out)


def combine_fragments(fragments: Column) -> Column:
    return compact_fragment(F.array_join(F.array_distinct(F.filter(fragments, lambda x: F.coalesce(x, F.lit("")) != "")), " | "))


COUNTRY_ALIASES = {"nl": "netherlands", "nederland": "netherlands", "the netherlands": "netherlands", "uk": "united kingdom", "gb": "united kingdom", "usa": "united states", "us": "united states"}


def conflict_key(name: Column, value: Column) -> Column:
    """What makes two values of a field the same: urls without www. and trailing slashes, countries by alias, names by their letters and digits, else the lower-cased text."""
    from quern.functions import urls

    alias = F.create_map(*[F.lit(x) for kv in COUNTRY_ALIASES.items() for x in kv])
    low = F.lower(compact(value))
    url = F.concat(urls.page_identity(value), F.when(urls.query(value) == "", "").otherwise(F.concat(F.lit("?"), urls.query(value))))
    return F.when(name.isin("website_url", "contact_page_url"), url).when(name == "country", F.coalesce(alias[low], low)).when(name == "company_name", F.regexp_replace(low, r"[^\p{L}\p{N}_]+", "")).otherwise(low)


def spreadsheet_cell(c: Column, limit: int) -> Column:
    """No NUL, each line's white space collapsed, at most limit characters, ' before a formula sign."""
    lines = F.transform(F.split(F.replace(F.replace(c, F.lit("\u0000"), F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n"), compact)
    text = F.substring(F.array_join(lines, "\n"), 1, limit)
    return F.when(text.rlike("^[=+@-]"), F.substring(F.concat(F.lit("'"), text), 1, limit)).otherwise(text)


def csv_guard(c: Column) -> Column:
    return F.when(F.regexp_replace(c, r"^\s+", "").rlike("^[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c)


#: Characters of texts that a Python worker holds as objects at once, one text at least.
CHARS_AT_ONCE = 1 << 20


def _by_parts(values: pa.Array, one: Callable[[str], str]) -> pa.Array:
    """one() of each text, null for null. Texts become Python objects a part at a time, so that a worker holds little but the Arrow batch and its result."""
    parts, begin, held = [], 0, 0
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    for i, size in enumerate(sizes):
        if held and held + size > CHARS_AT_ONCE:
            parts.append(pa.array([None if v is None else one(v) for v in values.slice(begin, i - begin).to_pylist()], pa.string()))
            begin, held = i, 0
        held += size
    parts.append(pa.array([None if v is None else one(v) for v in values.slice(begin).to_pylist()], pa.string()))
    return pa.concat_arrays(parts)


@F.arrow_udf(StringType())
def casefold(values: pa.Array) -> pa.Array:
    """Unicode case folding (Arrow); lower() keeps letters such as the sharp s."""
    return _by_parts(values, str.casefold)


@F.arrow_udf(StringType())
def compatibility_form(values: pa.Array) -> pa.Array:
    """NFKC (Arrow)."""
    from unicodedata import normalize

    return _by_parts(values, lambda v: normalize("NFKC", v))


@F.pandas_udf(StringType())
def ascii_domain(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """IDNA form of host names (Arrow); null if a name has none."""

    def one(name: str) -> str | None:
        try:
            return name.encode("idna").decode("ascii").lower()
        except UnicodeError:
            return None

    for v in values:
        yield v.map(one, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def json_strings(values: pd.Series) -> pd.Series:
    """All string leaves of a JSON text in order, compacted and case-folded (Arrow)."""
    import json

    def leaves(x) -> list[str]:
        if isinstance(x, str):
            return [" ".join(x.casefold().split())]
        if isinstance(x, list):
            return [s for y in x for s in leaves(y)]
        return [s for y in x.values() for s in leaves(y)] if isinstance(x, dict) else []

    def one(text):
        try:
            return leaves(json.loads(text))
        except ValueError:
            return []

    return values.map(one, na_action="ignore")


def similarity_percent(a: Column, b: Column) -> Column:
    """100 * (1 - edit distance / longer length), an integer: the fuzzy score of names."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100).otherwise(F.floor((longest - F.levenshtein(a, b)) * 100 / longest)).cast("int")
