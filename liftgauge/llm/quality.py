"""Quality rules whose thresholds follow the data.

Native: DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftgauge.session import written

ACCURACY = 2000
QUANTILES = [0.25, 0.5, 0.75, 0.9]
SPREADS = 4.0
#: What the wider sketch counts for, in texts, against a group's or a language's own texts.
WIDER_TEXTS = 1000
#: Where neither quartiles nor the upper tenth of a group, its language or the corpus differ.
LEAST_SPREAD = {"symbol_ratio": 0.005, "dup_line_ratio": 0.04, "word_length": 0.05}
SPACE = r"[\x20\x09-\x0D]"

#: The array is bound as a lambda's variable, so that looking up an element does not build the array again.
REPEAT_WORDS = """
    CASE WHEN size(_words) < 5 THEN 0L ELSE
    transform(array(_words), w ->
      transform(array(sort_array(transform(sequence(0, greatest(size(w) - 5, 0)),
          i -> struct(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2), get(w, i + 3), get(w, i + 4)) AS h,
                      hash(get(w, i + 4), get(w, i + 2), get(w, i + 3), get(w, i), get(w, i + 1)) AS g, i AS p)))),
        s -> aggregate(
          sort_array(transform(filter(s, (x, i) ->
              (x.h = get(s, i - 1).h AND x.g = get(s, i - 1).g) IS TRUE
              OR (x.h = get(s, i + 1).h AND x.g = get(s, i + 1).g) IS TRUE), x -> x.p)),
          struct(0L AS n, -5 AS last),
          (a, p) -> struct(a.n + least(5, p - a.last) AS n, p AS last),
          a -> a.n))[0])[0] END
"""


def with_measures(documents: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed to every row.

    Texts are taken whole; null and empty texts have no words and fail. Windows are compared by 96 bits of
    hash inside one text. The work on a text is a sort of its windows, whatever its length.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    measured = (
        documents.withColumns({"_words": words, "_lines": lines})
        .withColumns({
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.expr(REPEAT_WORDS).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
        })
        .drop("_words", "_lines")
    )
    return measured.withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _ratios(free: int = 0) -> dict[str, Column]:
    """The judged ratios; of counted signs and lines `free` are not counted."""
    def share(count: str, of: str) -> Column:
        return F.try_divide(F.greatest(F.col(count) - free, F.lit(0)), F.col(of))

    return {
        "symbol_ratio": share("n_symbols", "word_chars"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "word_length": F.try_divide(F.col("word_chars"), F.col("n_words")),
    }


def _group(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def thresholds(measured: DataFrame) -> DataFrame:
    """Lower and upper limits of each language and source, from quantile sketches that merge.

    Every task sketches its own rows and only sketches are shuffled, so one source may hold any share. Texts that
    fail the base rules say nothing about the others and are not sketched. A limit is a quartile and SPREADS times
    the spread away. Quantiles of a group are drawn towards those of its language, and these towards the corpus, by
    the weight of WIDER_TEXTS texts, so limits move little by little with every text of a group. The spread is that
    between quartiles, drawn in the same way; a sketch whose quartiles are equal leaves it to the wider one. Where
    no level has one, that from the median to the upper tenth does, found alike; and it is at least
    LEAST_SPREAD, so that groups of nearly equal texts do not reject what differs by a hair.
    `usual_words` is the middle number of words, `word_length_spread` the distance of its limits from the quartiles.
    """
    rows = measured.withColumns({**_ratios(), "_lang": _group("lang"), "_source": _group("source")})

    def sketched(level: str, *keys: str) -> DataFrame:
        good = lambda x: F.when(~F.col("base_failed"), x)
        return rows.groupBy(*keys).agg(
            F.count(good(F.lit(1))).alias(f"{level}_texts"),
            F.percentile_approx(good(F.col("n_words")), 0.5, ACCURACY).alias(f"{level}_words"),
            *(F.percentile_approx(good(F.col(r)), QUANTILES, ACCURACY).alias(f"{level}_{r}") for r in LEAST_SPREAD))

    levels = ("group", "language", "corpus")
    merged = (
        sketched("group", "_lang", "_source").join(sketched("language", "_lang"), "_lang")
        .crossJoin(F.broadcast(sketched("corpus"))))

    def drawn(of) -> Column:
        """The value that `of` finds in each level's columns, drawn from level to level towards the wider one."""
        values = [of(level) for level in levels]
        out = values[-1]
        for level, value in zip(levels[-2::-1], values[-2::-1], strict=True):
            own = F.col(f"{level}_texts")
            out = F.coalesce((own * value + WIDER_TEXTS * out) / (own + WIDER_TEXTS), out)
        return out

    def limits(ratio: str, least: float) -> list[Column]:
        quartiles = [drawn(lambda level, i=i: F.col(f"{level}_{ratio}")[i]) for i in range(3)]

        def between(low: int, high: int) -> Column:
            gap = lambda level: F.col(f"{level}_{ratio}")[high] - F.col(f"{level}_{ratio}")[low]
            return F.nullif(drawn(lambda level: gap(level) if level == "corpus" else F.nullif(gap(level), F.lit(0.0))), F.lit(0.0))

        steps = [between(0, 2), between(1, 3)]
        spread = SPREADS * F.greatest(F.coalesce(*steps, F.lit(least)), F.lit(least))
        return [(quartiles[0] - spread).alias(f"{ratio}_least"), (quartiles[2] + spread).alias(f"{ratio}_limit"),
                spread.alias(f"{ratio}_spread")]

    return merged.select(
        "_lang", "_source", drawn(lambda level: F.col(f"{level}_words")).alias("usual_words"),
        *(x for r, least in LEAST_SPREAD.items() for x in limits(r, least)))


def judged(documents: DataFrame, keep_text: bool = True) -> DataFrame:
    """All columns of `documents`, the measures and `kept`; a text within all limits of its group is kept.

    One sign or repeated line is chance in a short text, so the first of each is not counted against it. The mean
    word length of n words scatters as 1 / sqrt(n), so its limits are wider for texts with fewer words than usual.
    Null languages and sources are groups of their own. `documents` needs text, lang and source; its own columns
    named like a measure are replaced. The measured table is written once and read for sketches and verdicts.
    """
    measures = with_measures(documents)
    measured = written(measures if keep_text else measures.drop("text"), "quality-measures")
    limits = thresholds(measured)
    within = F.lit(True)
    scatter = F.greatest(F.lit(1.0), F.sqrt(F.try_divide(F.col("usual_words"), F.col("n_words")))) - 1
    wider = {"word_length": F.coalesce(F.col("word_length_spread") * scatter, F.lit(0.0))}
    for name, ratio in _ratios(free=1).items():
        more = wider.get(name, F.lit(0.0))
        inside = ratio.between(F.col(f"{name}_least") - more, F.col(f"{name}_limit") + more)
        within = within & F.coalesce(inside, F.lit(True))
    # One source may hold any share of the rows, so its limits are met in as many places as there are shuffle
    # partitions. A row's place counts up within its scan task, which a task run again repeats.
    salts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    place = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    return (
        measured.withColumns({"_lang": _group("lang"), "_source": _group("source"), "_salt": place})
        .join(salted, ["_lang", "_source", "_salt"], "left")
        .withColumn("kept", ~F.col("base_failed") & within)
        .drop("_lang", "_source", "_salt", "usual_words",
              *(f"{r}_{end}" for r in LEAST_SPREAD for end in ("least", "limit", "spread")))
    )


def quality_table(documents: DataFrame) -> DataFrame:
    return judged(documents.select("doc_id", "text", "lang", "source"), keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    packed = documents.select(F.struct("*").alias("_row"), "text", "lang", "source")
    return judged(packed, keep_text=False).where("kept").select("_row.*")
