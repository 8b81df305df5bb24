"""Text normalisation as column expressions: HTML to text and tokens."""

from __future__ import annotations

from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default stop words; a parameter wherever they are used.
STOP_WORDS = (
    "about above after again against all also and any are because been before being below between both but can cannot could did "
    "does doing down during each even every few for from further had has have having her here hers him his how into its itself "
    "just made make many may more most much must myself neither never nor not now off once one only other our ours out over own "
    "per perhaps please rather same seem several she should since some still such than that the their theirs them then there "
    "these they this those through thus too under until upon very via was well were what when where which while who whom whose "
    "why will with within without would yet you your yours"
).split()

#: White space and punctuation.
BETWEEN = r"[ \t\n\x0B\f\r!-/:-@\[-`{-~]+"

# Replacements before tags are stripped, in this order; (?s) for . over lines, (?U) for Unicode white space.
HTML_RULES = (
    (r"\n", " "),
    (r"(?sU)<code>.*?</code>", " codesnippet "),
    (r"(?sU)<a.*?https?://.*?[\x08\s]?>", " url "),
    (r"(?sU)https?://.*?(?:[\x08\s]|\z)", " url "),
    (r"(?sU)<img.*?>", " img "),
)
#: What holds no text, then tags.
STRIP_RULES = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?s)<script[^>]*>.*?</script>", ""),
    (r"(?s)<style[^>]*>.*?</style>", ""),
    (r"(?s)<[a-z/!][^>]*>", ""),
)


def _chain(text: Column, rules) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def mark_html(text: Column) -> Column:
    """Lower case, with code, links and images replaced by words; tags are still there."""
    return _chain(F.lower(text), HTML_RULES)


def _named_entities() -> dict[str, str]:
    """The characters of HTML's named entities, by names in lower case; a blank for the one that doesn't break."""
    found = {name[:-1].lower(): char for name, char in sorted(html5.items(), reverse=True) if name.endswith(";")}
    return found | {name[:-1]: char for name, char in html5.items() if name.endswith(";") and name.islower()} | {"nbsp": " "}


def decode_entities(text: Column) -> Column:
    """A text in lower case with its entities as characters, in one pass: what comes out of one isn't read as another. Unknown ones stay."""
    pairs = F.lit("\x02".join(f"{k}\x01{v}" for k, v in _named_entities().items()))
    table = F.str_to_map(pairs, F.lit("\x02"), F.lit("\x01"))
    number = lambda e: F.when(e.startswith("&#x"), F.conv(F.regexp_replace(e, "^&#x|;$", ""), 16, 10)).otherwise(F.regexp_replace(e, "[^0-9]", "")).try_cast("int")
    known = lambda n: n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    coded = lambda e: F.when(known(number(e)), F.decode(F.unhex(F.lpad(F.hex(number(e)), 8, "0")), "UTF-32"))
    char = lambda e: F.when(F.replace(e, F.lit(";"), F.lit("")) == "&#38", "&").when(e.startswith("&#"), coded(e)).otherwise(F.element_at(table, F.regexp_replace(e, "[&;]", "")))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]*);"), F.lit(0)))
    swaps = F.filter(F.transform(found, lambda e: F.struct(char(e).alias("by"), e.alias("e"))), lambda x: x["by"].isNotNull())
    # the ampersand comes last, for it may make up what looks like another entity
    ordered = F.concat(F.filter(swaps, lambda x: x["by"] != "&"), F.filter(swaps, lambda x: x["by"] == "&"))
    return F.when(text.contains("&"), F.aggregate(ordered, text, lambda t, x: F.replace(t, x["e"], x["by"]))).otherwise(text)


def process_html(text: Column) -> Column:
    """mark_html and the text of what is left. Native; html_text() follows a parser where tags are malformed."""
    return decode_entities(_chain(mark_html(text), STRIP_RULES))


def tokens(text: Column, stop_words: tuple[str, ...] | list[str] = tuple(STOP_WORDS), shortest: int = 3) -> Column:
    """Tokens of a text: lower case, tags and digits dropped, cut at punctuation and spaces, stop words and short words dropped."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "<([^>]+)>", ""), "[0-9]+", "")
    stop = list(stop_words)
    return F.filter(F.split(plain, BETWEEN), lambda t: (F.length(t) >= shortest) & ~t.isin(stop) if stop else F.length(t) >= shortest)
