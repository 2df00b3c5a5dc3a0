"""Entities of a text: known compound names first, then capitalised words that aren't common ones."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import LEFT, RIGHT, bind

WINDOW, LEAST_COUNT, LEAST_LETTERS, MOST, MOST_SALIENT = 5000, 2, 3, 25, 5
# Words that begin sentences or name days, months and roles; never entities.
STOP_WORDS = (
    "The", "This", "That", "These", "Those", "When", "Where", "What", "Why", "Who", "Which", "How", "After", "Before", "Then", "Now", "Here", "There", "And", "But", "Or", "Yet", "So", "If", "Else",
    "Yes", "No", "Maybe", "Okay", "User", "Assistant", "System", "Tool", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "May",
    "June", "July", "August", "September", "October", "November", "December",
)
# Names of several words that count as one.
COMPOUNDS = (
    "Claude Code", "Claude Desktop", "Claude Sonnet", "Claude Opus", "Claude Haiku", "Claude Sonnet 4.5", "Claude Sonnet 4.6", "Claude Opus 4.5", "Claude Opus 4.6",
    "Claude Opus 4.7", "Gemini Code Assist", "Gemini 1.5 Pro", "Gemini 2.5 Pro", "Gemini 2.5 Flash", "Gemini Pro", "Gemini Flash", "GitHub Copilot", "GitHub Copilot CLI",
    "Microsoft Copilot", "Visual Studio Code", "Visual Studio", "IntelliJ IDEA", "Android Studio", "Sublime Text", "Replit Agent", "Docker Desktop", "Docker Compose",
    "GitHub Actions", "GitHub Pages", "GitHub Codespaces", "GitHub Pull Request", "Hugging Face", "Stack Overflow", "Stack Exchange", "Hacker News", "Y Combinator",
    "Google Cloud Platform", "Amazon Web Services", "Microsoft Azure", "Azure DevOps", "Notion AI", "OpenAI API", "Anthropic Console", "GPT-4", "GPT-4o", "GPT-5",
    "Llama 3", "Llama 3.1", "Mistral Small", "Mistral Large", "Microsoft Word", "Microsoft Excel", "Microsoft PowerPoint", "Google Docs", "Google Sheets", "Google Drive",
    "Google Cloud", "Apple Watch", "Apple TV",
)
_LONGEST_FIRST = sorted(COMPOUNDS, key=lambda c: -len(c.encode()))
#: What a text holds, in lower case, that has a compound: the compounds that hold no other.
CORES = sorted({c.lower() for c in COMPOUNDS if not any(o.lower() in c.lower() for o in COMPOUNDS if o != c)})
#: All compounds in one pattern: at a place the longest wins.
COMPOUND = rf"(?i){LEFT}({'|'.join(re.escape(c) for c in _LONGEST_FIRST)}){RIGHT}"


def _canonical(found: Column) -> Column:
    names = F.create_map(*[F.lit(x) for c in COMPOUNDS for x in (c.lower(), c)])
    return F.transform(found, lambda f: names[F.lower(f)])


def mentions(text: Column) -> Column:
    """All entity mentions in the first WINDOW characters: compounds, then single words outside them."""
    word = F.lit(r"(\p{Lu}\p{L}*)")

    def found(window: Column) -> Column:
        # cheaper to look for than the pattern, whose every place tries all compounds
        some = bind(F.lower(window), lambda low: reduce(or_, (F.contains(low, F.lit(c)) for c in CORES)))
        plain = F.regexp_extract_all(window, word, 1)
        return F.when(some, F.concat(_canonical(F.regexp_extract_all(window, F.lit(COMPOUND), 1)), _named(F.regexp_extract_all(F.regexp_replace(window, COMPOUND, " "), word, 1)))).otherwise(_named(plain))

    return bind(F.substring(text, 1, WINDOW), found)


def _named(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


#: Words that a list of everyday words may have; it becomes part of the plan.
MOST_EVERYDAY = 20_000


def with_mentions(rows: DataFrame, text: str, name: str, common: DataFrame | None = None) -> DataFrame:
    """rows with the array of a text's mentions. common: a column `word` of lower-case words that are no entities, of MOST_EVERYDAY
    words at most, being a word list; compounds stay."""
    found = rows.withColumn(name, mentions(F.col(text)))
    if common is None:
        return found
    words = [r.w for r in common.where("word is not null").select(F.lower("word").alias("w")).distinct().limit(MOST_EVERYDAY + 1).collect()]  # bounded
    if len(words) > MOST_EVERYDAY:
        raise ValueError(f"over {MOST_EVERYDAY} everyday words")

    def listed(values: list[str]) -> str:
        return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) or "null"

    return found.withColumn(name, F.expr(f"filter(`{name}`, w -> w in ({listed([*COMPOUNDS])}) or not coalesce(lower(w) in ({listed(words)}), false))"))


def counted(found: Column) -> Column:
    """(entity, n) for each entity of an array of mentions, by entity."""

    def each(m: Column) -> Column:
        return F.transform(F.sort_array(F.array_distinct(m)), lambda e: F.struct(e.alias("entity"), (F.size(m) - F.size(F.array_remove(m, e))).cast("long").alias("n")))

    return bind(found, each)  # else the optimizer may put the search of the text in m's place, within the loop over entities


def entities_within(found: Column) -> Column:
    """What `drawer_entities` gives for one array of mentions."""
    often = F.filter(counted(found), lambda x: (x["n"] >= LEAST_COUNT) & (F.length(x["entity"]) >= LEAST_LETTERS))
    return F.slice(F.transform(often, lambda x: x["entity"]), 1, MOST)


def salient_within(found: Column) -> Column:
    """What `salient_entities` gives for one array of mentions."""
    often = F.filter(counted(found), lambda x: x["n"] >= LEAST_COUNT)
    ranked = F.sort_array(F.transform(often, lambda x: F.struct((-x["n"]).alias("n"), x["entity"].alias("entity"))))
    return F.transform(F.slice(ranked, 1, MOST_SALIENT), lambda x: x["entity"])


def frequencies(rows: DataFrame, key: str, text: str, common: DataFrame | None = None) -> DataFrame:
    """(key, entity, n) of every text, counted within its row; a key that comes with several texts has a row for each."""
    each = with_mentions(rows.select(key, F.col(text).alias("__t")), "__t", "__m", common)
    return each.select(key, F.explode(counted(F.col("__m"))).alias("__e")).select(key, "__e.entity", "__e.n")


def named(rows: DataFrame, key: str, text: str, common: DataFrame | None = None, salient: bool = False) -> DataFrame:
    """(key, entities) of the texts that have any: the first MOST by name, or the MOST_SALIENT most frequent."""
    each = with_mentions(rows.select(key, F.col(text).alias("__t")), "__t", "__m", common)
    entities = (salient_within if salient else entities_within)(F.col("__m"))
    return each.select(key, F.explode(F.array(entities)).alias("entities")).where(F.size("entities") > 0)  # not pushed below explode, so texts are searched once


def drawer_entities(found: DataFrame, key: str) -> DataFrame:
    """(key, entities): named twice or more, three letters or more, the first MOST by name."""
    kept = found.where((F.col("n") >= LEAST_COUNT) & (F.length("entity") >= LEAST_LETTERS))
    return kept.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("entity")), 1, MOST).alias("entities"))


def salient_entities(found: DataFrame, key: str) -> DataFrame:
    """(key, entities): named twice or more, the MOST_SALIENT most frequent, ties by name."""
    order = Window.partitionBy(key).orderBy(F.desc("n"), "entity")
    kept = found.where(F.col("n") >= LEAST_COUNT).withColumn("at", F.row_number().over(order)).where(F.col("at") <= MOST_SALIENT)
    return kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "entity"))).alias("e")).select(key, F.col("e.entity").alias("entities"))
