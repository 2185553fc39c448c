"""Text features: tokens, lemmas, phrases, frequencies, TF-IDF, one-hot triples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import saved
from .joins import join_counted, parts

#: Letters and digits of all scripts, underscores and apostrophes.
TOKEN = r"[\p{L}\p{N}_']+"
#: Terms that are looked for one by one in a text; more of them are looked for together.
FEW = 500
#: Bytes of words that are handed to every task as one table; beyond it they are joined.
BROADCAST = 16_000_000


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(TOKEN), F.lit(0))


def wc_log(col: Column) -> Column:
    """ln(1 + number of tokens); 0 for a missing text."""
    return F.log1p(F.coalesce(F.size(tokens(col)), F.lit(0)).cast("double"))


def as_value(col: Column) -> Column:
    """Spaces as underscores, on values and vocabulary alike."""
    return F.translate(col, " ", "_")


def feature_name(field: Column | str, value: Column) -> Column:
    return F.lower(F.translate(F.concat(F.lit(field) if isinstance(field, str) else field, F.lit("_ENUM_"), as_value(value)), ".", "_"))


def flatten_values(lists: Column, unique: bool = False) -> Column:
    """The elements of a list of lists in order, each once if unique; missing inner lists hold none, a missing outer list stays null."""
    flat = F.flatten(F.filter(lists, lambda x: x.isNotNull()))
    return F.array_distinct(flat) if unique else flat


def numeric_features(counts: dict[str, Column], larger: dict[str, tuple[Column, Column]], numbers: dict[str, Column], flags: dict[str, Column]) -> dict[str, Column]:
    """Columns by name: counts such as sizes of lists (0 of a missing list), the larger of a number and a count, numbers (0 where missing), and whether a number is there (1 or 0)."""
    zero = F.lit(0)
    count = lambda c: F.greatest(F.coalesce(c, zero), zero)  # noqa: E731  size() of null is null or -1
    found = {n: count(c) for n, c in counts.items()} | {n: F.greatest(F.coalesce(a, zero), count(b)) for n, (a, b) in larger.items()}
    return found | {n: F.coalesce(c, zero) for n, c in numbers.items()} | {n: c.isNotNull().cast("int") for n, c in flags.items()}


def long_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value): values of scalar fields, lists and lists of lists; null and empty lists give one null value."""
    parts = []
    for f in fields:
        kind = df.schema[f].dataType.typeName()
        nested = kind == "array" and df.schema[f].dataType.elementType.typeName() == "array"
        value = F.explode_outer(flatten_values(F.col(f)) if nested else f) if kind == "array" else F.col(f)
        parts.append(df.select(key, F.lit(f).alias("field"), value.cast("string").alias("value") if kind != "array" else value.alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_vocab(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, value): distinct values with spaces as underscores, and `absent` for each field."""
    values = long_values(df, key, fields).where("value is not null").select("field", as_value(F.col("value")).alias("value")).distinct()
    absent = values.select("field").distinct().withColumn("value", F.lit("absent"))
    return values.unionByName(absent).distinct()


def row_features(df: DataFrame, fields: list[str]) -> Column:
    """The distinct feature names of a row's values (long_values)."""
    named = lambda f: lambda v: feature_name(f, F.coalesce(v, F.lit("absent")))
    names = []
    for f in fields:
        kind = df.schema[f].dataType
        lists = F.col(f) if kind.typeName() == "array" else F.array(f)
        lists = flatten_values(lists) if kind.typeName() == "array" and kind.elementType.typeName() == "array" else lists
        some = F.when(F.size(lists) > 0, lists.cast("array<string>")).otherwise(F.array(F.lit(None).cast("string")))
        names.append(F.transform(some, named(f)))
    return F.array_distinct(F.concat(*names))


def one_hot(df: DataFrame, key: str, fields: list[str], one_row: bool = False) -> DataFrame:
    """(key, feature, value 1.0) for values that occur; missing values are `absent`.

    one_row: df has one row a key, so that nothing is shuffled. Else rows of a key meet in as many parts as spark.sql.shuffle.partitions says: short names compress so well that parts merged by bytes would hold far more of them.
    """
    found = df.select(key, F.explode(row_features(df, fields)).alias("feature"), F.lit(1.0).alias("value"))
    return found if one_row else found.repartition(parts(df), key, "feature").distinct()


def one_hot_dense(df: DataFrame, key: str, fields: list[str], vocab: DataFrame) -> DataFrame:
    """(key, feature, value 0 or 1) for each row and word of the vocabulary. The vocabulary is small: distinct values of enumerations."""
    words = vocab.select(feature_name(F.col("field"), F.col("value")).alias("feature")).distinct()
    listed = words.groupBy().agg(F.sort_array(F.collect_set("feature")).alias("words"))
    every = df.select(key).distinct().join(F.broadcast(listed)).select(key, F.explode("words").alias("feature"))
    return every.join(one_hot(df, key, fields), [key, "feature"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def recode_absent(col: Column, marks: tuple[str, ...] = ("???", "Other", "UNKNOWN", "Unknown")) -> Column:
    return F.when(~col.isin(*marks), col)


def drop_leaky(features: DataFrame, name_col: str = "feature") -> DataFrame:
    """Without features that tell the label: names with both `reference_` and `exploit`."""
    return features.where(~(F.contains(F.col(name_col), F.lit("reference_")) & F.contains(F.col(name_col), F.lit("exploit"))))


#: Noun endings and what stands in their place, the first that fits; three characters at least stand before them (two before ss, us and s).
ENDINGS = [("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"), ("ss", "ss"), ("us", "us"), ("s", "")]


def lemma(word: Column) -> Column:
    """Noun endings taken off: ses, xes, zes, ches, shes, men, ies, s."""
    out = word
    for ending, to in reversed(ENDINGS):
        fits = F.endswith(word, F.lit(ending)) & (F.length(word) >= len(ending) + 3)
        out = F.when(fits, word if ending == to else F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(to))).otherwise(out)
    return F.when(F.endswith(word, F.lit("s")) | F.endswith(word, F.lit("men")), out).otherwise(word)


def _plain_lemma(word: str) -> str:
    """lemma() of one word."""
    for ending, to in ENDINGS:
        if word.endswith(ending) and len(word) >= len(ending) + 3:
            return word[: -len(ending)] + to
    return word


def lemmatize(words: DataFrame, word_col: str, exceptions: DataFrame | None = None) -> DataFrame:
    """words with `lemma`: the exception list's (word, lemma), else by rule."""
    if exceptions is None:
        return words.withColumn("lemma", lemma(F.col(word_col)))
    known = exceptions.select(F.col("word").alias(word_col), F.col("lemma").alias("__known"))
    return words.join(known, word_col, "left").withColumn("lemma", F.coalesce("__known", lemma(F.col(word_col)))).drop("__known")


def _small(words: DataFrame, *cols: str) -> list | None:
    """All rows of a table of words, or None where their texts hold more than BROADCAST bytes."""
    size = words.agg(F.sum(sum((F.octet_length(c) + 50 for c in cols), F.lit(0)))).first()[0] or 0
    return words.select(*cols).collect() if size <= BROADCAST else None


def lemmatized_text(df: DataFrame, key: str, text_col: str, exceptions: DataFrame | None = None) -> DataFrame:
    """(key, text): tokens' lemmas joined by a space, one row a row with text. exceptions (word, lemma) take the place of the rules.

    Texts stay where they are: the exceptions are looked up beside them, and a token that was resolved once is remembered. Only where the list holds more than BROADCAST bytes, tokens travel to it.
    """
    texts = df.where(F.col(text_col).isNotNull()).select(key, F.col(text_col).alias("text"))
    if exceptions is None:
        return texts.select(key, F.array_join(F.transform(tokens(F.col("text")), lemma), " ").alias("text"))
    listed = _small(exceptions, "word", "lemma")
    if listed is None:
        word = texts.select(key, F.posexplode_outer(tokens(F.col("text"))).alias("pos", "word"))
        done = lemmatize(word, "word", exceptions).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "lemma"))).alias("w"))
        return done.select(key, F.array_join(F.col("w.lemma"), " ").alias("text"))
    known = {r.word: r.lemma for r in listed if r.lemma is not None}
    words = texts.select(key, tokens(F.col("text")).alias("words"))
    name = key

    def run(batches):
        memo: dict[str, str] = {}
        for batch in batches:
            out = []
            for row in batch.column("words").to_pylist():
                if len(memo) > 500_000:
                    memo.clear()
                for w in set(row) - memo.keys():
                    memo[w] = known.get(w) or _plain_lemma(w)
                out.append(" ".join(map(memo.__getitem__, row)))
            yield pa.RecordBatch.from_arrays([batch.column(name), pa.array(out, pa.string())], [name, "text"])

    return words.mapInArrow(run, texts.schema)


def phrase_list(text: Column, stop_words: list[str], max_words: int = 5) -> Column:
    """Distinct runs of tokens between stop words, of max_words words at most, lower case. Stop words become line ends, at which the row's own text is cut: nothing is shuffled."""
    marked = F.transform(tokens(F.lower(text)), lambda w: F.when(w.isin(*stop_words), F.lit("\n")).otherwise(w))
    runs = F.transform(F.split(F.array_join(marked, " "), "\n"), lambda r: F.trim(r))
    return F.array_distinct(F.filter(runs, lambda r: (r != "") & (F.size(F.split(r, " ")) <= max_words)))


def phrases(df: DataFrame, key: str, text_col: str, stop_words: list[str], max_words: int = 5) -> DataFrame:
    """(key, phrase), distinct within a row: the phrases of phrase_list. df has one row a key."""
    return df.select(key, F.explode(phrase_list(F.col(text_col), stop_words, max_words)).alias("phrase"))


def substring_counts(text: str, terms: list[str]) -> list[int]:
    """Occurrences of each term in a text, without overlap from the left, 1 at least. Linear in the text: more than FEW terms are found in one pass by an automaton."""
    import ahocorasick

    if len(terms) <= FEW:
        return [max(1, text.count(t)) for t in terms]
    trie = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        trie.add_word(t, k)
    trie.make_automaton()
    size, free, n = [len(t) for t in terms], [0] * len(terms), [0] * len(terms)
    for end, k in trie.iter(text):
        if end - size[k] + 1 >= free[k]:
            n[k] += 1
            free[k] = end + 1
    return [max(1, x) for x in n]


def phrase_counts(df: DataFrame, key: str, text_col: str, stop_words: list[str], max_words: int = 5, noise: list[str] | None = None, min_df: int = 1) -> DataFrame:
    """(key, phrase, tf, df): phrases that stand in min_df rows at least, with their occurrences in the row's text and the rows that have them. Phrases that match one of the
    `noise` patterns from their start go. df has one row a key.

    Each text is passed once for all of its phrases, where it stands; only phrases with their counts are written and travel on. Rows of a phrase are counted over as many parts as
    spark.sql.shuffle.partitions says, so that the table of phrases that a task holds is their share of all, however well they compress.
    """
    cut = phrase_list(F.col(text_col), stop_words, max_words)
    cut = F.filter(cut, lambda p: ~_is_noise(p, noise)) if noise else cut
    texts = df.where(F.col(text_col).isNotNull()).select(key, F.col(text_col).alias("text"), cut.alias("phrase"))
    name, schema = key, df.select(key).withColumns({"phrase": F.lit(""), "tf": F.lit(0).cast("long")}).schema

    def run(batches):
        for batch in batches:
            at, terms, tf = [], [], []
            for k, own in enumerate(batch.column("phrase").to_pylist()):
                if own:
                    at += [k] * len(own)
                    terms += own
                    tf += substring_counts(batch.column("text")[k].as_py(), own)
            yield pa.RecordBatch.from_arrays([batch.column(name).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(tf, pa.int64())], [name, "phrase", "tf"])

    counted = saved(texts.mapInArrow(run, schema), "counted")
    rows = counted.select("phrase").repartition(parts(df), "phrase").groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    frequent = saved(rows.where(F.col("df") >= min_df), "phrases")
    return join_counted(counted, frequent, "phrase", "df").select(key, "phrase", "tf", "df")


def _is_noise(col: Column, patterns: list[str]) -> Column:
    return col.rlike("^(?:" + "|".join(patterns) + ")")


def drop_noise(df: DataFrame, col: str, patterns: list[str]) -> DataFrame:
    """Without rows whose text starts with one of the patterns."""
    return df.where(~_is_noise(F.col(col), patterns))


def read_patterns(spark: SparkSession, path: str) -> list[str]:
    """Patterns of a text file, one a line, for drop_noise; blank lines and lines that begin with # are left out. A list of a family's noise is short, so it goes through the driver."""
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").collect()
    return [r.value for r in rows]


def doc_frequency(df: DataFrame, key: str, tag_col: str, min_df: int) -> DataFrame:
    """(tag, df): tags that stand in min_df documents at least."""
    return df.select(key, tag_col).distinct().groupBy(tag_col).agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)


def term_frequency(text: Column, term: Column) -> Column:
    """Occurrences of a term in a text, 1 at least."""
    return F.greatest(((F.length(text) - F.length(F.replace(text, term))) / F.length(term)).cast("long"), F.lit(1).cast("long"))


def tfidf(counts: DataFrame, key: str, tag_col: str, tf_col: str, n_docs: DataFrame, min_df: int = 1) -> DataFrame:
    """(key, tag, value): tf * ln(documents / df). counts: one row a key and tag, with df where it was counted before; n_docs: one row with n."""
    known = counts if "df" in counts.columns else counts.join(doc_frequency(counts, key, tag_col, min_df), tag_col)
    return known.where(F.col("df") >= min_df).join(F.broadcast(n_docs)).select(key, tag_col, (F.col(tf_col) * F.log(F.col("n") / F.col("df"))).alias("value"))
