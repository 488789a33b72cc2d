"""Search of a table of symbols and regular expressions over source lines, by an index of words.

``build_index`` writes the lines of all ``.py`` files, which word stands in which line, and every distinct word once with
the number of its lines. A pattern is sought by its required parts: the stretches of its text that any line it matches must
hold inside of one word (``required_parts``). Parts meet the distinct words by an equi-join on three letters, the part that
fewest lines hold is chosen, and only the lines with one of its words are read and tested in full. So a pattern costs what
its rarest part costs, however large the sources are. A pattern that cannot match a blank or look around it stands inside of
a word or nowhere: it is tested on the distinct words, and only the lines that it finds are read. What has no part of three
letters is tested against the lines of its code base, all such patterns in one pass over them.

Words are what stands between blanks. Patterns are literal texts, regular expressions of Java, or basic ones of POSIX as
``grep`` takes them (``basic_pattern``). A blank pattern finds nothing; one that is not a regular expression fails the job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.text import strip
from tracelake.operators.late import ADDRESS, file_rows, stored
from tracelake.operators.source import INSTANCE, source_lines

GRAM = 3
# Characters that mean something in a regular expression; with a backslash they stand for themselves.
MARKS = r".[]^$*(){}+?|\/-"
# Private-use characters: a gap, and the first of those that stand for escaped marks.
GAP, HELD = "\uf000", 0xE100
# What the parts of an expression are not taken from: flags and groups that look around, escapes that name characters,
# classes in classes.
OPAQUE = r"\(\?|\\[xuUpPQENckRX0-9]|\[[^\]]*\[|&&|\[\^?\]"
GROUP_DEPTH = 4
# Expressions that match no blank and look at nothing around them: no flags, anchors or dots, only escaped marks and classes of
# word characters and signs that no range can stretch to a blank.
IN_WORD = r"(?s)(?:[^ \\.^$\[(]|\((?!\?)|\\[.\[\]^$*(){}+?|\\/-]|\[[A-Za-z0-9_-]+\])*"
# Up to so many words that patterns ask for are sent to every task, rather than moving the words of all lines to them.
WORDS_SENT = 500_000


@dataclass(frozen=True)
class CodeIndex:
    """Where the tables of an index are, and the columns that name a code base."""

    path: str
    keys: tuple[str, ...]

    def lines(self, spark: SparkSession) -> DataFrame:
        """(keys, path, line_no, line) with the address of each."""
        return file_rows(spark.read.parquet(f"{self.path}/lines")).rows()

    def words(self, spark: SparkSession) -> DataFrame:
        """(keys, word, address): each word of a line once."""
        return spark.read.parquet(f"{self.path}/words")

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """(word, n_lines): each word once."""
        return spark.read.parquet(f"{self.path}/vocabulary")


def build_index(spark: SparkSession, files: DataFrame, path: str, keys: Sequence[str] = INSTANCE) -> CodeIndex:
    """Write the index of the ``.py`` files below ``path``, in place of what is there."""
    index = CodeIndex(path, tuple(keys))
    lines = source_lines(files.where(F.col("path").endswith(".py")), keys).where(F.col("line") != "")
    lines.write.mode("overwrite").parquet(f"{path}/lines")
    word = F.explode(F.array_distinct(F.split("line", " ", -1))).alias("word")
    index.lines(spark).select(*keys, word, ADDRESS).where(F.col("word") != "").write.mode("overwrite").parquet(f"{path}/words")
    counted = index.words(spark).groupBy("word").agg(F.count(F.lit(1)).alias("n_lines"))
    counted.write.mode("overwrite").parquet(f"{path}/vocabulary")
    return index


def basic_pattern(pattern: Column) -> Column:
    """A basic regular expression of POSIX as one of Java: marks and escaped marks of groups, counts and choices swap."""
    for n, mark in enumerate("(){}+?|"):
        pattern = F.replace(pattern, F.lit("\\" + mark), F.lit(chr(HELD + n)))
    for n, mark in enumerate("(){}+?|"):
        pattern = F.replace(F.replace(pattern, F.lit(mark), F.lit("\\" + mark)), F.lit(chr(HELD + n)), F.lit(mark))
    return pattern


def required_parts(pattern: Column, is_regex: Column) -> Column:
    """Texts of three letters and more without blanks that every matching line holds inside of a word; may be empty."""
    literal = F.split(pattern, " ", -1)
    rest = pattern
    for n, mark in enumerate(MARKS):
        rest = F.replace(rest, F.lit("\\" + mark), F.lit(chr(HELD + n)))
    # Classes, then groups from the inside, then other escapes, repeated and optional characters, anchors.
    steps = [(r"\[[^\]]*\]", GAP), *[(r"\([^()]*\)", GAP)] * GROUP_DEPTH, (r"\\.", GAP)]
    steps += [(r"(?s).(?:[?*]|\{[^}]*\})[?+]?", GAP), (r"(?s)(.)\+[?+]?", f"$1{GAP}"), (r"[.^$]", GAP)]
    rest = reduce(lambda text, step: F.regexp_replace(text, *step), steps, rest)
    parts = F.split(F.replace(rest, F.lit(" "), F.lit(GAP)), GAP, -1)
    parts = F.transform(parts, lambda p: F.translate(p, "".join(chr(HELD + n) for n in range(len(MARKS))), MARKS))
    # A choice at the top, or what was not understood, requires nothing.
    open_ended = F.regexp_like(pattern, F.lit(OPAQUE)) | F.regexp_like(rest, F.lit(r"[|()\[\]{}*?+\\]"))
    found = F.when(~is_regex, literal).when(open_ended, F.array().cast("array<string>")).otherwise(parts)
    return F.array_distinct(F.filter(found, lambda p: F.length(p) >= GRAM))


def search_patterns(spark: SparkSession, index: CodeIndex, patterns: DataFrame) -> DataFrame:
    """(keys, pattern, is_regex, path, line_no, line): every line that a pattern of (keys, pattern, is_regex) finds.

    Each pattern is sought once, however often it is listed. Without a column ``is_regex`` patterns are literal.
    """
    keys = list(index.keys)
    found = _found(spark, index, _asked(index, patterns))
    return found.select(*keys, "pattern", "is_regex", "path", "line_no", "line")


def _asked(index: CodeIndex, patterns: DataFrame) -> DataFrame:
    """(keys, pattern, is_regex, _parts): each pattern that is not blank, once."""
    is_regex = F.coalesce(F.col("is_regex"), F.lit(False)) if "is_regex" in patterns.columns else F.lit(False)
    asked = patterns.select(*index.keys, strip(F.col("pattern")).alias("pattern"), is_regex.alias("is_regex")).distinct()
    return asked.where(F.col("pattern") != "").withColumn("_parts", required_parts(F.col("pattern"), F.col("is_regex")))


def _found(spark: SparkSession, index: CodeIndex, asked: DataFrame) -> DataFrame:
    return _by_words(spark, index, asked.where(F.size("_parts") > 0)).unionByName(
        _by_lines(spark, index, asked.where(F.size("_parts") == 0))
    )


def _by_words(spark: SparkSession, index: CodeIndex, asked: DataFrame) -> DataFrame:
    """Lines with a word that holds the rarest part of a pattern, tested in full."""
    lines = index.lines(spark).join(_met(spark, index, asked).drop(*index.keys), ADDRESS)
    about = F.col("pattern"), F.col("is_regex")
    return lines.where(_in_word(*about) | _holds(F.col("line"), *about)).drop(ADDRESS)


def _met(spark: SparkSession, index: CodeIndex, asked: DataFrame) -> DataFrame:
    """(keys, pattern, is_regex, address): each line with a word that holds the rarest part of a pattern, once.

    If a pattern can only match inside of a word, it is each line with a word that it matches.
    """
    keys = list(index.keys)
    parts = asked.select(F.explode("_parts").alias("part")).distinct().withColumn("gram", F.substring("part", 1, GRAM))
    vocabulary = index.vocabulary(spark)
    starts = F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - GRAM + 1, F.lit(1))), lambda n: F.substring(F.col("word"), n, F.lit(GRAM)))
    )
    grams = vocabulary.select("word", "n_lines", F.explode(starts).alias("gram"))
    matched = grams.join(parts, "gram").where(F.col("word").contains(F.col("part"))).select("part", "word", "n_lines")
    sizes = matched.groupBy("part").agg(F.sum("n_lines").alias("_n"))
    # The part that fewest lines hold; a part that no word holds is met by no line.
    by_part = asked.withColumn("part", F.explode("_parts")).join(sizes, "part", "left")
    rarest = by_part.groupBy(*keys, "pattern", "is_regex").agg(
        F.min_by("part", F.struct(F.coalesce("_n", F.lit(0)), F.col("part"))).alias("part")
    )
    wanted = rarest.join(matched.select("part", "word"), "part").select(*keys, "pattern", "is_regex", "word")
    about = F.col("pattern"), F.col("is_regex")
    wanted = stored(wanted.where(~_in_word(*about) | _holds(F.col("word"), *about)), "wanted-words")
    wanted = F.broadcast(wanted) if wanted.count() <= WORDS_SENT else wanted
    return index.words(spark).join(wanted, [*keys, "word"]).select(*keys, "pattern", "is_regex", ADDRESS).distinct()


def _by_lines(spark: SparkSession, index: CodeIndex, asked: DataFrame) -> DataFrame:
    """Lines against all patterns of their code base that have no part to look up."""
    keys = list(index.keys)
    lists = asked.groupBy(*keys).agg(F.collect_list(F.struct("pattern", "is_regex")).alias("_asked"))
    lines = index.lines(spark).drop(ADDRESS)
    joined = lines.join(lists, keys) if keys else lines.crossJoin(F.broadcast(lists))
    hits = F.filter("_asked", lambda a: _holds(F.col("line"), a["pattern"], a["is_regex"]))
    return joined.select(*lines.columns, F.inline(hits))


def _in_word(pattern: Column, is_regex: Column) -> Column:
    """Whether a pattern that requires a part can only match inside of one word."""
    return F.when(is_regex, F.regexp_like(pattern, F.lit(f"^{IN_WORD}$"))).otherwise(~pattern.contains(" "))


def _holds(line: Column, pattern: Column, is_regex: Column) -> Column:
    return F.when(is_regex, F.regexp_like(line, pattern)).otherwise(line.contains(pattern))


def pattern_requests(
    spark: SparkSession, index: CodeIndex, requests: DataFrame, request_key: str = "request_id"
) -> DataFrame:
    """Hits for a table of (request, keys, pattern, is_regex), one row per request and hit."""
    keys = list(index.keys)
    is_regex = F.coalesce(F.col("is_regex"), F.lit(False)) if "is_regex" in requests.columns else F.lit(False)
    asked = requests.select(request_key, *keys, strip(F.col("pattern")).alias("pattern"), is_regex.alias("is_regex"))
    hits = search_patterns(spark, index, requests)
    # Hits of a pattern that most lines hold are many; adaptive execution splits them, as nothing above needs them together.
    on = [*keys, "pattern", "is_regex"]
    return hits.join(asked, on).select(request_key, *on, "path", "line_no", "line")


def pattern_counts(spark: SparkSession, index: CodeIndex, patterns: DataFrame) -> DataFrame:
    """(keys, pattern, is_regex, hits): the number of lines of each pattern that finds any."""
    asked, on = _asked(index, patterns), [*index.keys, "pattern", "is_regex"]
    # A literal without blanks stands in a line if it stands in a word of it, so no line has to be read.
    is_part = ~F.col("is_regex") & (F.size("_parts") == 1) & (F.col("_parts")[0] == F.col("pattern"))
    hits = _met(spark, index, asked.where(is_part)).select(*on).unionByName(
        _found(spark, index, asked.where(~is_part)).select(*on)
    )
    return hits.groupBy(*on).agg(F.count(F.lit(1)).alias("hits"))
