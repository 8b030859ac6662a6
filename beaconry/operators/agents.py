"""User agents by an ordered rule table: each distinct string once, candidates by literals, templates by capture groups.

A rule is (section, rule_idx, pattern, family, v1, v2, bot): the first rule of a section that matches names its family and
version. A table may have thousands of rules; testing every string against every rule would be a nested loop. Most
patterns cannot match without some literal text, so a rule is filed under a few letters of its literals, a string is
looked up by its own runs of letters, and only the rules that it meets there are tested.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from beaconry.functions import scalars as fn

#: Letters that rules are filed under.
GRAM = 4
RULE_SCHEMA = "section string, rule_idx int, pattern string, family string, v1 string, v2 string, bot boolean"

# A short rule table; section, order, pattern, and templates of family, major and minor version, bot.
UA_RULES = [
    ("browser", 0, r"(Googlebot)/([0-9]+)\.([0-9]+)", None, None, None, False), ("browser", 1, r"(Edg)/([0-9]+)\.([0-9]+)", "Edge", None, None, False), ("browser", 2, r"(Firefox)/([0-9]+)\.([0-9]+)", None, None, None, False),
    ("browser", 3, r"(Chrome)/([0-9]+)\.([0-9]+)", None, None, None, False), ("browser", 4, r"(Version)/([0-9]+)\.([0-9]+).*Safari", "Safari", None, None, False), ("os", 0, r"(Windows NT) ([0-9]+)\.([0-9]+)", "Windows", None, None, False),
    ("os", 1, r"(iPhone OS) ([0-9]+)_([0-9]+)", "iOS", None, None, False), ("os", 2, r"(Mac OS X) ([0-9]+)_([0-9]+)", None, None, None, False), ("os", 3, r"(Android) ([0-9]+)", None, None, None, False), ("os", 4, r"(Linux)", None, None, None, False),
    ("device", 0, r"(Googlebot)", "Spider", None, None, True), ("device", 1, r"(iPhone)", "iPhone", None, None, False), ("device", 2, r"; (Pixel [0-9]+)\)", None, None, None, False), ("device", 3, r"(SM-[A-Z0-9]+)", "Samsung $1", None, None, False),
]


def rule_table(spark) -> DataFrame:
    return spark.createDataFrame(UA_RULES, RULE_SCHEMA)


def ua_dictionary(requests: DataFrame, column: str = "user_agent") -> DataFrame:
    """Each user agent once, so that rules run on distinct strings only."""
    return requests.select(F.col(column).alias("user_agent")).where("user_agent IS NOT NULL").distinct()


def required_literals(pattern: str) -> list[str]:
    """Lower-case texts of which every match holds one; [''] if none is known.

    Of the runs of literal characters that stand in every match, the set whose shortest text is longest; of a choice, one
    text for each branch. What cannot be read as a pattern here has no known literals and is tested against every string.
    """
    import re._parser as parser

    def best(sets: list[list[str]]) -> list[str]:
        most = max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=[""])
        return most if all(most) else [""]

    def of(items) -> list[list[str]]:
        found, run = [], ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL" and 0x20 <= arg < 0x7F:
                run += chr(arg).lower()
                continue
            inner: list[list[str]] = []
            if name == "SUBPATTERN":
                inside = list(arg[3])
                if all(str(o) == "LITERAL" and 0x20 <= a < 0x7F for o, a in inside):
                    run += "".join(chr(a).lower() for _, a in inside)
                    continue
                inner = of(inside)
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                inner = of(arg[2])
            elif name == "ATOMIC_GROUP":
                inner = of(arg)
            elif name == "BRANCH":
                every = [best(of(b)) for b in arg[1]]
                inner = [sorted({x for b in every for x in b})]
            elif name == "AT":
                continue
            found.extend(inner)
            if run:
                found.append([run])
            run = ""
        return [*found, [run]] if run else found

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            parsed = parser.parse(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
    except Exception:  # another dialect, or no pattern at all
        return [""]
    # Verbose patterns ignore blanks, so their literals are not what they seem.
    return [""] if parsed.state.flags & 64 else best(of(parsed)) if len(parsed) else [""]


def _literals(patterns: Column) -> Column:
    """Of the rule table only: a row a rule."""
    return F.pandas_udf(lambda p: p.map(lambda x: required_literals(x or "")), ArrayType(StringType()))(patterns)


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of so many characters, and ''."""
    n = F.greatest(F.length(text) - size + 1, F.lit(0))
    runs = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(runs, F.array(F.lit(""))))


def index_rules(rules: DataFrame) -> DataFrame:
    """Rules with their number of capture groups, once for each literal: gram (what they are filed under) and literal.

    A group is a parenthesis that is neither escaped nor in a character class nor the start of `(?...)`, but for names.
    """
    bare = F.regexp_replace(F.regexp_replace("pattern", r"(?s)\\Q.*?(\\E|$)|\\.", ""), r"\[\^?\]?[^\]]*\]", "")
    counted = rules.withColumn("groups", F.regexp_count(bare, F.lit(r"\((?!\?)|\(\?P?<(?![=!])"))).withColumn("literal", F.explode(_literals("pattern")))
    # A literal's letters: the last ones, as common words share their beginnings; too short a literal is filed under ''.
    return counted.withColumn("gram", F.when(F.length("literal") >= GRAM, F.right("literal", F.lit(GRAM))).otherwise(""))


def candidates(agents: DataFrame, indexed: DataFrame) -> DataFrame:
    """(user_agent, rule) pairs that can match: rules filed under letters of the string and whose literal it holds."""
    met = agents.withColumn("low", F.lower("user_agent")).withColumn("gram", F.explode(_grams(F.col("low"), GRAM)))
    return met.join(indexed, "gram").where(F.contains("low", F.col("literal"))).drop("low", "gram", "literal")


def _group(i: int) -> Column:
    return F.expr(f"CASE WHEN r.groups >= {i} THEN regexp_extract(user_agent, r.pattern, {i}) ELSE '' END")


def _expanded(template: Column) -> Column:
    """A template with $n, ${n} and $$ filled in; other names are empty, as letters go on a name."""
    groups = F.array(*[_group(i) for i in range(10)])
    tokens = F.regexp_extract_all(template, F.lit(r"\$\{[0-9A-Za-z_]*\}|\$[0-9A-Za-z_]+|\$\$|\$|[^$]+"), F.lit(0))
    number = lambda t: F.regexp_extract(t, r"^\$\{?([0-9]{1,6})\}?$", 1)
    fill = lambda t: F.when(t == "$$", "$").when(number(t) != "", F.coalesce(F.get(groups, number(t).cast("int")), F.lit(""))).when(t.rlike(r"^\$[0-9A-Za-z_{]"), "").otherwise(t)
    return F.trim(F.array_join(F.transform(tokens, fill), ""))


def _resolved(template: Column, fallback: int) -> Column:
    """A template's text, itself if it has no numbers in it, or without one the capture group; '' if there is nothing."""
    return F.when(F.coalesce(F.trim(template), F.lit("")) == "", _group(fallback)).when(template.rlike(r"\$[0-9]"), _expanded(template)).otherwise(template)


def match_rules(agents: DataFrame, rules: DataFrame) -> DataFrame:
    """Per user agent: family and version of each section by its first matching rule, its device, and whether it is a bot.

    A browser's family takes the first group in place of $1 only; other templates take all groups. A version is major,
    or major.minor; without a major there is none. Rules are the small side, and Spark broadcasts them where it can.
    """
    hits = candidates(agents, index_rules(rules)).where(F.expr("user_agent RLIKE pattern"))
    best = hits.groupBy("user_agent", "section").agg(F.min_by(F.struct("pattern", "groups", "family", "v1", "v2", "bot"), "rule_idx").alias("r"))
    family = F.when(F.col("section") == "browser", F.coalesce(F.replace("r.family", F.lit("$1"), _group(1)), _group(1))).otherwise(_resolved(F.col("r.family"), 1))
    major, minor = F.nullif(_resolved(F.col("r.v1"), 2), F.lit("")), F.nullif(_resolved(F.col("r.v2"), 3), F.lit(""))
    named = best.select("user_agent", "section", family.alias("family"), F.when(major.isNull(), "").otherwise(F.concat_ws(".", major, minor)).alias("version"), F.col("r.bot").alias("bot"))
    pick = lambda s, c: F.coalesce(F.max(F.when(F.col("section") == s, F.col(c))), F.lit(""))
    wide = named.groupBy("user_agent").agg(pick("browser", "family").alias("browser"), pick("browser", "version").alias("browser_version"), pick("os", "family").alias("os"), pick("os", "version").alias("os_version"), pick("device", "family").alias("device_family"), F.bool_or(F.when(F.col("section") == "device", F.col("bot"))).alias("bot"))
    out = agents.join(wide, "user_agent", "left").fillna("", ["browser", "browser_version", "os", "os_version", "device_family"])
    bot = F.coalesce("bot", F.lit(False))
    return out.withColumn("bot", bot).withColumn("device", F.when(bot, "Bot").otherwise(fn.classify_device(F.col("user_agent"))))
