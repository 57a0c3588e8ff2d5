"""Stages between tables: merging entries, meaning vectors, hypotheses, graphs, exports, the store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seeds as S
from ..functions import words as W
from ..functions.alignment import alignment
from ..functions.drift import DIMENSIONS, meaning_distance

GRAPH = ["word", "root", "hypothesis_type", "attestations", "cognates", "donor_language", "confidence"]
PROPERTIES = [("word", "string"), ("lang", "string"), ("confidence_score", "double"), ("donor_language", "string"), ("record", "string")]


def placeholder(meaning: Column) -> Column:
    return F.coalesce(meaning == "", F.lit(True)) | F.startswith(F.coalesce(meaning, F.lit("")), F.lit("Online"))


def merge_entries(entries: DataFrame) -> DataFrame:
    """One entry for each (query_word, lang_code, word): the earliest that isn't a placeholder, else the earliest, by priority and
    ordinal. It stands where the key was first met: priority and ordinal are those of the key's earliest entry."""
    order = F.struct(placeholder(F.col("meaning")).alias("p"), "priority", "ordinal")
    rest = [c for c in entries.columns if c not in ("query_word", "lang_code", "word", "priority", "ordinal")]
    best = entries.groupBy("query_word", "lang_code", "word").agg(F.min_by(F.struct(*rest), order).alias("e"), F.min(F.struct("priority", "ordinal")).alias("first"))
    return best.select("query_word", "lang_code", "word", "e.*", "first.*")


def rank_of(code: Column) -> Column:
    return F.when(code == "otk", 0.0).when(code == "ai", 0.3).when(code == "donor", 0.5).otherwise(1.0)


def spread_by_word(entries: DataFrame) -> DataFrame:
    """(query_word, languages, codes, ratio, score, assessment): the spread goes by names of languages; ``codes`` counts languages themselves."""
    name, code = (F.nullif(c, F.lit("")) for c in ("lang_name", "lang_code"))
    n = entries.groupBy("query_word").agg(F.countDistinct(name).alias("languages"), F.size(F.collect_set(code)).cast("long").alias("codes"))
    return n.select("query_word", "languages", "codes", W.spread(F.col("languages")).alias("s")).select("query_word", "languages", "codes", "s.*")


def gram_weights(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dim, weight): hashed n-gram weights 1 + ln(frequency), scaled to length one and rounded to 4 places."""
    grams = rows.select(key, F.explode(W.ngrams(F.col(text))).alias("gram")).groupBy(key, "gram").count()
    dim = (F.conv(F.substring(F.md5(F.col("gram").cast("binary")), 1, 8), 16, 10).cast("long") % DIMENSIONS).cast("int")
    sums = grams.groupBy(key, dim.alias("dim")).agg(F.sum(F.lit(1.0) + F.log(F.col("count"))).alias("x"))
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return sums.join(norms, key).select(key, "dim", W.round_n(F.col("x") / F.col("norm"), 4).alias("weight"))


def drift(rows: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, distance, acceleration, plausible) between two meanings; blank ones are plausible at distance 0."""
    judged = rows.select(key, meaning_distance(F.col(old), F.col(new)).alias("distance"))
    return judged.select(key, drift_of(F.col("distance")).alias("d")).select(key, "d.*")


def drift_of(distance: Column) -> Column:
    """struct(distance, acceleration, plausible)."""
    speed = W.round_n(distance * 1.10, 3)
    return F.struct(distance.alias("distance"), speed.alias("acceleration"), (speed <= 0.85).alias("plausible"))


def referee(hypotheses: DataFrame, *keep: str, report: bool = False) -> DataFrame:
    """Verdicts on (id, word, origin, donor, proof, meaning, attestation): sounds .35, dates .30, meaning .15, cognates .20.

    Rows are judged where they lie, nothing is shuffled; the columns named in ``keep`` are passed on. With ``report``
    the verdict's badge, percentage, stages and reasons follow."""
    origin = W.unstar(F.trim(F.coalesce("origin", F.lit(""))))
    base = hypotheses.withColumn("from", F.when(origin == "", F.col("word")).otherwise(origin)).withColumn("chain", W.chain(W.normalise(F.col("from")), W.normalise(F.col("word"))))
    base = base.withColumns({"a": W.letters(F.col("from"), S.ALPHABET_A), "b": W.letters(F.col("word"), S.ALPHABET_A)})
    base = base.withColumns({"al": alignment("a", "b"), "distance": meaning_distance(F.lower("meaning"), F.lower("proof"))})
    known = (F.coalesce("meaning", F.lit("")) != "") & (F.coalesce("proof", F.lit("")) != "")
    source = F.concat(F.coalesce("donor", F.lit("")), F.lit(" "), F.coalesce("proof", F.lit("")))
    more = []
    if report:
        text = lambda x: x.cast("string")
        speed, forms = drift_of(F.col("distance"))["acceleration"], W.candidates(W.normalise(F.col("word")))
        anachronism = F.when(~W.time_lock(source, F.col("attestation")), W.filled(S.ANACHRONISM, source, text(W.year(source)), F.col("attestation"), text(W.year(F.col("attestation")))))
        sense = F.when(~known, S.NO_SENSE).when(speed <= 0.85, S.GOOD_SENSE).otherwise(W.filled(S.BAD_SENSE, text(speed)))
        more = [F.col("chain.rules").alias("rules"), F.col("chain.violations").alias("violations"), "al", anachronism.alias("time_violation"), sense.alias("sense_reason"), F.size(forms).alias("cognate_count"), F.slice(forms, 1, 6).alias("sample_cognates")]
    staged = base.select(
        *keep, "id", "word", F.col("from").alias("origin"), F.col("al.similarity").alias("similarity"),
        (F.col("chain.is_valid") & ((F.col("al.similarity") > 0.15) | (F.col("from") == F.col("word")))).alias("sound_valid"),
        F.col("chain.is_valid").alias("chain_valid"),
        W.round_n(F.col("chain.score") * 0.6 + F.col("al.similarity") * 0.4, 3).alias("sound"),
        W.time_lock(source, F.col("attestation")).alias("time_valid"),
        F.when(known, F.greatest(F.lit(0.20), W.round_n(1.0 - F.col("distance"), 3))).otherwise(0.85).alias("sense"),
        F.when(W.has_candidates(W.normalise(F.col("word"))), 0.95).otherwise(0.60).alias("cognate"),
        *more,
    )
    score = F.col("sound") * 0.35 + F.col("time_valid").cast("double") * 0.30 + F.col("sense") * 0.15 + F.col("cognate") * 0.20
    score = F.when(F.col("sound_valid"), score).otherwise(score * 0.4)
    score = F.when(F.col("time_valid"), score).otherwise(F.least(score, F.lit(0.30)))
    free = F.col("chain_valid") & F.col("time_valid")  # reasons to reject come from a broken chain or a date
    status = F.when(free & (F.col("total") >= 0.75), "VALIDATED").when(free & (F.col("total") >= 0.50), "NEEDS_REVIEW").otherwise("REJECTED")
    judged = staged.withColumn("total", score).withColumn("status", status).withColumn("confidence", W.round_n(F.col("total"), 3))
    if report:
        badge = reduce(lambda acc, kv: acc.when(F.col("status") == kv[0], F.lit(kv[1])), list(S.BADGES.items())[1:], F.when(F.col("status") == "VALIDATED", F.lit(S.BADGES["VALIDATED"])))
        percent = F.concat(F.lit("%"), W.round_n(F.col("total") * 100, 1).cast("string"))
        late = F.filter(F.array("time_violation"), F.isnotnull)
        judged = judged.withColumns({"badge": badge, "score_percentage": percent, "rejection_reasons": F.concat(F.when(F.col("sound_valid"), F.array().cast("array<string>")).otherwise(F.col("violations")), late)})
    return judged.drop("total", "chain_valid")


def node_list(w: Column, root: Column, hypothesis_type: Column, attestations: Column, cognates: Column, donor: Column, confidence: Column) -> Column:
    """Array of struct(node_id, kind, label, properties): the word, its root, the case, at most 4 attestations and 5 cognates."""
    donor = F.coalesce(donor, F.lit(S.NATIVE_DONOR))

    def node(i: Column, kind: str, label: Column, **told: Column) -> Column:
        properties = F.struct(*[told.get(k, F.lit(None)).cast(t).alias(k) for k, t in PROPERTIES])
        return F.struct(i.alias("node_id"), F.lit(kind).alias("kind"), label.alias("label"), properties.alias("properties"))

    root = W.unstar(F.coalesce(F.nullif(root, F.lit("")), w))
    case = F.concat(F.lit(S.CASE_LABEL), F.substring(F.coalesce(hypothesis_type, F.lit(S.CASE_DEFAULT)), 1, 25))
    starred = F.concat(F.lit("*"), root)
    fixed = F.array(
        node(F.concat(F.lit("word_"), w), "Word", w, word=w, lang=F.lit("tr")),
        node(F.concat(F.lit("proto_"), root), "ProtoForm", starred, word=starred, lang=donor),
        node(F.concat(F.lit("case_"), w), "Case", case, confidence_score=F.coalesce(confidence, F.lit(0.90)), donor_language=donor),
    )
    numbered = lambda p, i: F.concat(F.lit(p), w, F.lit("_"), i.cast("string"))
    records = F.transform(F.slice(attestations, 1, 4), lambda x, i: node(numbered("att_", i), "Attestation", F.substring(x, 1, 30), record=x))
    return F.concat(fixed, records, F.transform(F.slice(cognates, 1, 5), lambda x, i: node(numbered("cog_", i), "Cognate", x, word=x)))


def graph_nodes(words: DataFrame) -> DataFrame:
    """(word, node_id, kind, label, properties) of words with the columns ``GRAPH``, by :func:`node_list`."""
    return words.select("word", F.inline(node_list(*map(F.col, GRAPH))))


def edge_list(w: Column, root: Column, attestations: Column, cognates: Column) -> Column:
    """Array of struct(edge_id, source, target, relation, label): the word from its root, its case and attestations, the root to its cognates."""
    root = F.concat(F.lit("proto_"), W.unstar(F.coalesce(F.nullif(root, F.lit("")), w)))
    edge = lambda s, t, r: F.struct(F.concat(F.lit("edge_"), s, F.lit("_"), t).alias("edge_id"), s.alias("source"), t.alias("target"), F.lit(r).alias("relation"), F.lit(S.EDGE_LABELS[r]).alias("label"))
    me = F.concat(F.lit("word_"), w)
    ids = lambda c, n, p: F.transform(F.slice(c, 1, n), lambda _, i: F.concat(F.lit(p), w, F.lit("_"), i.cast("string")))
    fixed = F.array(edge(root, me, "DERIVED_FROM"), edge(me, F.concat(F.lit("case_"), w), "HAS_CASE"))
    return F.concat(fixed, F.transform(ids(attestations, 4, "att_"), lambda x: edge(me, x, "ATTESTED_IN")), F.transform(ids(cognates, 5, "cog_"), lambda x: edge(root, x, "COGNATE_OF")))


def graph_edges(words: DataFrame) -> DataFrame:
    """(word, edge_id, source, target, relation, label) of words with the columns of :func:`graph_nodes`, by :func:`edge_list`."""
    return words.select("word", F.inline(edge_list(*map(F.col, ["word", "root", "attestations", "cognates"]))))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(word, node_count, edge_count)."""
    each = nodes.select("word", F.lit(1).alias("n"), F.lit(0).alias("e")).union(edges.select("word", F.lit(0), F.lit(1)))
    return each.groupBy("word").agg(F.sum("n").alias("node_count"), F.sum("e").alias("edge_count"))


def graph_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(word, elements): a word's nodes and edges as one JSON list for viewers, nodes first."""
    part = lambda df, order: df.select("word", F.struct(F.lit(order).alias("o"), F.to_json(F.struct(F.struct(*[c for c in df.columns if c != "word"]).alias("data"))).alias("e")).alias("x"))
    both = part(nodes, 0).union(part(edges, 1))
    listed = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"])
    return both.groupBy("word").agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("elements"))


def cldf_forms(entries: DataFrame) -> DataFrame:
    """CLDF form rows of (word, position, lang_code, form): ids by position from 1, letters as segments."""
    return entries.select(F.concat(F.lit("form_"), (F.col("position") + 1).cast("string")).alias("id"), F.col("lang_code").alias("language_id"), F.concat(F.lit("param_"), F.col("word")).alias("parameter_id"), "form", F.col("form").alias("value"), F.array_join(F.filter(F.split("form", ""), lambda x: x != ""), " ").alias("segments"))


def cldf_cognates(entries: DataFrame, source: str = "lexichron") -> DataFrame:
    """CLDF cognate rows of (word, root, position, form): one set for each root; a missing root is the word."""
    number = (F.col("position") + 1).cast("string")
    return entries.select(F.concat(F.lit("cog_"), number).alias("id"), F.concat(F.lit("form_"), number).alias("form_id"), F.concat(F.lit("cogset_"), F.coalesce("root", "word")).alias("cognateset_id"), F.col("form").alias("alignment"), F.lit(source).alias("source"))


def cldf_metadata(words: DataFrame, title: str = "Wordlist - {}") -> DataFrame:
    return words.select("word", F.lit("1.2").alias("cldf_version"), F.lit("http://cldf.clld.org/v1.0/terms.rdf#Wordlist").alias("conforms_to"), W.filled(title, F.col("word")).alias("title"))


def upsert(stored: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The rows of both tables with the highest version of each key (``new`` and ``stored`` share a schema)."""
    both = stored.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), version).alias("r")).select("r.*")


def adjacent_pairs(words: DataFrame) -> DataFrame:
    """(a, b): each word and the next in code point order that shares its first three letters."""
    return words.select(F.col("w").alias("a"), F.lead("w").over(Window.partitionBy(F.substring("w", 1, 3)).orderBy("w")).alias("b")).where("b is not null")


def initial_pairs(words: DataFrame) -> DataFrame:
    """(a, b): words that differ in their first letter alone, a before b. A remainder has no more words than the alphabet has letters."""
    cut = lambda c: words.where("length(w) > 1").select(F.substring("w", 2, 2147483647).alias("rest"), F.col("w").alias(c))
    return cut("a").join(cut("b"), "rest").where("a < b").select("a", "b")


def stored_list(findings: DataFrame, created: str, number: str) -> DataFrame:
    """All stored rows, the newest first; of equal times the higher number."""
    return findings.orderBy(F.desc(created), F.desc(number))


def stored_word(findings: DataFrame, word: str) -> DataFrame:
    """The row of one word, trimmed and lower-cased; the filter reaches the scan."""
    return findings.where(F.col("query_word") == W.normalise(F.lit(word)))


def surviving(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there (a cascade of deletions)."""
    return children.join(parents.select(key), key, "left_semi")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def synthesis(findings: DataFrame) -> DataFrame:
    """(query_word, text): a finding in a sentence or two, by its hypothesis's donor."""
    w, h, record = F.col("query_word"), F.col("hypothesis"), W.first_record(F.col("query_word"))
    loan = W.filled(S.LOAN_TEXT, w, h["donor"], h["origin"], h["proof"], record)
    own = W.filled(S.NATIVE_TEXT, w, F.col("proto_root"), F.col("root_meaning"), record)
    return findings.select("query_word", F.when(h["donor"] != S.NATIVE_DONOR, loan).otherwise(own).alias("text"))
