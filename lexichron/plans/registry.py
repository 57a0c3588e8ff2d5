"""All queries of the word-history operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seeds as S
from ..functions import words as W
from ..functions.alignment import alignment
from ..operators import relational as R
from ..sources import lexicon
from . import oracle
from .oracle import align, candidate_list, drift, edits, laws, letters, listed, overlap, picked, q, rounded, rx, translated, year

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "search_offline"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of all documents, as ``w``."""
    each = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")
    return read(spark, sf_dir, "documents").select(each).where("w <> ''").distinct()


def head_pairs(spark: SparkSession) -> DataFrame:
    """(a, b): the words of all dictionary entries with their headwords."""
    return lexicon.entries(spark).select(F.lower("word").alias("a"), F.col("headword").alias("b")).distinct()


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): words next to each other that start alike, words that differ in their initial, and dictionary entries with their headwords."""
    words = tokens(spark, sf_dir)
    return R.adjacent_pairs(words).union(R.initial_pairs(words)).union(head_pairs(spark))


# The SQL of the views above, and of rule tables
_LEXICON = "x(headword, source, priority, ordinal, lang_code, lang_name, word, meaning, script) AS (VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in lexicon.entry_rows()) + ")"
_HEAD_PAIRS = "SELECT DISTINCT lower(word) AS a, headword AS b FROM x"
T = r"t AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS w FROM documents) WHERE w <> '')"
P = f"""{T}, {_LEXICON}, p AS (SELECT * FROM (SELECT w AS a, lead(w) OVER (PARTITION BY substring(w, 1, 3) ORDER BY w) AS b FROM t) WHERE b IS NOT NULL
 UNION ALL SELECT i.w, j.w FROM t i JOIN t j ON substring(i.w, 2) = substring(j.w, 2) AND i.w < j.w WHERE length(i.w) > 1 UNION ALL {_HEAD_PAIRS})"""
FOREIGN, RARE = f"substring(w, 1, 1) IN ({', '.join(map(q, S.FOREIGN_INITIALS))})", f"substring(w, 1, 1) IN ({', '.join(map(q, S.RARE_INITIALS))})"
HARMONY = "(regexp_matches(w, '[aıou]') AND regexp_matches(w, '[eiöü]'))"


def count_true(xs) -> str:
    return " + ".join(f"({x})::INT" for x in xs)


@query(f"WITH {T} SELECT w, regexp_replace(w, '[^{S.ALPHABET_A}]', '', 'g') AS a, regexp_replace(w, '[^{S.ALPHABET_B}]', '', 'g') AS b FROM t")
def tok_alphabet_filter(spark, d):
    return tokens(spark, d).select("w", W.letters(F.col("w"), S.ALPHABET_A).alias("a"), W.letters(F.col("w"), S.ALPHABET_B).alias("b"))


@query("SELECT page_id, CASE WHEN regexp_matches(html, '[Ѐ-ӿ]') THEN 'Cyrillic' WHEN regexp_matches(html, '[؀-ۿ]') THEN 'Arabic' WHEN regexp_matches(html, '[Ͱ-Ͽ]') THEN 'Greek' ELSE 'Latin' END AS script FROM pages")
def page_script(spark, d):
    return read(spark, d, "pages").select("page_id", W.script(F.col("html")).alias("script"))


@query(r"SELECT part.p_partkey, regexp_replace(lower(regexp_replace(' ' || chr(9) || p_name || ' ', '^\s+|\s+$', '', 'g')), '^\*+', '') AS name FROM part")
def name_normalise(spark, d):
    padded = F.concat(F.lit(" \t"), F.col("p_name"), F.lit(" "))
    return read(spark, d, "part").select("p_partkey", W.unstar(W.normalise(padded)).alias("name"))


_STRIP = f"list_reduce({listed(S.SUFFIXES)}, lambda acc, x: CASE WHEN ends_with(acc, x) AND length(acc) - length(x) >= 3 THEN left(acc, length(acc) - length(x)) ELSE acc END, w)"


@query(f"WITH {T} SELECT w, CASE WHEN {FOREIGN} THEN w ELSE {_STRIP} END AS stem FROM t")
def morph_strip(spark, d):
    return tokens(spark, d).select("w", W.strip_suffixes(F.col("w"))["stem"].alias("stem"))


_CUT = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(s, '^.{{2,}}({p})$') THEN regexp_extract(s, '({p})$', 1) END" for p in map("|".join, S.SEGMENTS)) + ")"
_SEGMENTED = f"""r(w, s, i, affixes) AS (SELECT w, regexp_replace(w, '[^{S.ALPHABET_B}]', '', 'g'), 0, ''::VARCHAR FROM t
UNION ALL SELECT w, left(s, length(s) - length(cut)), i + 1, '-' || cut || affixes FROM (SELECT *, {_CUT} AS cut FROM r WHERE length(s) >= 3) WHERE cut IS NOT NULL),
segmented AS (SELECT w, arg_max(s, i) AS stem, arg_max(affixes, i) AS affixes FROM r GROUP BY w)"""


@query(f"WITH RECURSIVE {T}, {_SEGMENTED} SELECT * FROM segmented")
def morph_segment(spark, d):
    cut = tokens(spark, d).select("w", W.segment(F.col("w")).alias("m"))
    return cut.select("w", "m.stem", F.array_join("m.affixes", "").alias("affixes"))


@query(f"WITH {T}, l AS (SELECT w, {candidate_list('w')} AS c FROM t) SELECT w, len(c) AS n, array_to_string(c, ' ') AS forms FROM l")
def variants_rows(spark, d):
    all_of = tokens(spark, d).select("w", W.candidates(F.col("w")).alias("c"))
    return all_of.select("w", F.size("c").cast("long").alias("n"), F.array_join("c", " ").alias("forms"))


_CLUSTER = "(" + " OR ".join(f"starts_with(w, {q(x)})" for x in S.CLUSTERS) + ")"
_BREACHES = [RARE, _CLUSTER, HARMONY, *[rx("w", p) for p, _ in S.ARABIC], *[f"ends_with(w, {q(x)})" for x in [*S.PERSIAN, *S.WESTERN]]]
_SEA = "(CASE WHEN substring(w, 1, 1) IN ('f', 'h', 'p', 'v') THEN 4.0::DOUBLE ELSE 0 END)"
_EAST = f"({_SEA} + 6.0::DOUBLE * ({count_true(rx('w', p) for p, _ in S.ARABIC)}) + 5.0::DOUBLE * ({count_true(f'ends_with(w, {q(x)})' for x in S.PERSIAN)}))"
_WEST = f"((CASE WHEN substring(w, 1, 1) IN ('j', 'z', 'r', 'l') THEN 5.0::DOUBLE ELSE 0 END) + 6.0::DOUBLE * {_CLUSTER}::INT + 6.0::DOUBLE * ({count_true(f'ends_with(w, {q(x)})' for x in S.WESTERN)}))"
_NATIVE = f"greatest(10.0::DOUBLE - 8.5::DOUBLE * ({RARE})::INT - 9.0::DOUBLE * {_CLUSTER}::INT - 4.5::DOUBLE * {HARMONY}::INT, 0.5::DOUBLE)"
_told = lambda form, x: " || ".join([q(form.split("{}")[0]), x, q(form.split("{}")[1])])
_FIRST_CLUSTER = "CASE " + " ".join(f"WHEN starts_with(w, {q(x)}) THEN {q(x)}" for x in S.CLUSTERS) + " END"
_BREACH_NAMES = [_told(S.BREACH_INITIAL, "substring(w, 1, 1)"), _told(S.BREACH_CLUSTER, _FIRST_CLUSTER), q(S.BREACH_HARMONY), *[_told(S.BREACH_ARABIC, q(n)) for _, n in S.ARABIC], *[_told(S.BREACH_PERSIAN, q(x)) for x in S.PERSIAN], *[_told(S.BREACH_WESTERN, q(x)) for x in S.WESTERN]]
_BREACH_TEXTS = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in zip(_BREACHES, _BREACH_NAMES, strict=True)) + "], lambda x: x IS NOT NULL)"
CLASSIFIED = f"""s AS (SELECT w, {_NATIVE} AS n, {_EAST} AS e, {_SEA} AS g, {_WEST} AS x, {count_true(_BREACHES)} AS n_violations, {_BREACH_TEXTS} AS violations FROM t),
r AS (SELECT w, n_violations, violations, {', '.join(f"floor({c} / (n + e + g + x) * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE AS {k}" for c, k in (('n', 'p_native'), ('e', 'p_arabic_persian'), ('g', 'p_greek_latin'), ('x', 'p_western')))} FROM s),
c AS (SELECT * EXCLUDE (violations), array_to_string(violations, '; ') AS violations, CASE WHEN p_native >= 0.65 THEN {q(S.CLASSES['native'])} WHEN p_greek_latin > p_arabic_persian AND p_greek_latin >= p_western THEN {q(S.CLASSES['greek'])}
 WHEN p_greek_latin = p_arabic_persian AND substring(w, 1, 1) IN ('h', 'k', 'p', 'f') THEN {q(S.CLASSES['mediterranean'])}
 WHEN p_arabic_persian >= greatest(p_greek_latin, p_western) THEN {q(S.CLASSES['east'])} WHEN p_greek_latin >= p_western THEN {q(S.CLASSES['greek'])} ELSE {q(S.CLASSES['west'])} END AS classification FROM r)"""


@query(f"WITH {T}, {CLASSIFIED} SELECT * FROM c")
def loan_classify(spark, d):
    return tokens(spark, d).select("w", W.classify(F.col("w")).alias("c")).select("w", "c.*").withColumn("violations", F.array_join("violations", "; "))


@query(rf"""WITH l AS (SELECT DISTINCT lang, w FROM (SELECT lang, unnest(string_split_regex(lower(text), '[^\p{{L}}]+')) AS w FROM documents) WHERE w <> ''),
t AS (SELECT DISTINCT w FROM l), {CLASSIFIED} SELECT lang, classification, count(*) AS words FROM l JOIN c USING (w) GROUP BY lang, classification""")
def loan_by_lang(spark, d):
    each = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")
    words = read(spark, d, "documents").select("lang", each).where("w <> ''").groupBy("w").agg(F.collect_set(F.struct("lang")).alias("langs"))  # a word is classified once
    return words.select("langs", W.classify(F.col("w")).alias("c")).select(F.inline("langs"), F.col("c.classification").alias("classification")).groupBy("lang", "classification").agg(F.count("*").alias("words"))


_RULE = "coalesce(" + ", ".join(f"CASE WHEN {rx('w', p)} THEN {i} END" for i, p in enumerate(S.NEOLOGISMS, 1)) + ")"
_NEO_PROOF = _told(S.NEOLOGISM_PROOF, f"{listed(S.NEOLOGISM_NOTES)}[rule]")


@query(f"WITH {T}, n AS (SELECT w, {_RULE} AS rule FROM t WHERE length(w) >= 3) SELECT w, rule, rule IS NOT NULL AS is_neologism, CASE WHEN rule IS NOT NULL THEN {q(S.NEOLOGISM_TYPE)} END AS derivation_type, CASE WHEN rule IS NOT NULL THEN {_NEO_PROOF} END AS etymology_details FROM n")
def neologism(spark, d):
    return tokens(spark, d).where(F.length("w") >= 3).select("w", W.neologism(F.col("w")).alias("rule"), W.neologism_report(F.col("w")).alias("r")).select("w", "rule", "r.*").withColumn("is_neologism", F.col("rule").isNotNull())


_PHONO = f"concat_ws('; ', CASE WHEN {FOREIGN} THEN {_told(S.PHONOTACTIC_INITIAL, 'substring(w, 1, 1)')} END, CASE WHEN {HARMONY} THEN {q(S.PHONOTACTIC_HARMONY)} END)"


@query(f"WITH {T}, k AS (SELECT w, ({FOREIGN})::INT + {HARMONY}::INT AS breaches, {_PHONO} AS x FROM t) SELECT w, breaches, CASE WHEN x <> '' THEN {q(S.PHONOTACTIC_HEAD)} || x ELSE {q(S.PHONOTACTIC_CLEAN)} END AS report FROM k")
def phonotactics(spark, d):
    return tokens(spark, d).select("w", W.phonotactics(F.col("w")).alias("breaches"), W.phonotactic_report(F.col("w")).alias("report"))


@query(f"WITH {T} SELECT w, array_to_string({picked((rx('w', p), v) for p, v in S.DONOR_PATTERNS)}, '; ') AS patterns FROM t")
def donor_patterns(spark, d):
    return tokens(spark, d).select("w", F.array_join(W.donor_patterns(F.col("w")), "; ").alias("patterns"))


_IPA = lambda c: f"replace(replace(translate({c}, '{S.IPA_FROM}', '{S.IPA_TO}'), 'c', 'dʒ'), 'ç', 'tʃ')"


@query(f"WITH {T} SELECT w, '/' || {_IPA('w')} || '/' AS ipa, CASE WHEN {HARMONY} THEN {q(S.OUT_OF_HARMONY)} ELSE {q(S.IN_HARMONY)} END AS vowel_harmony_status, length(regexp_replace(w, '[^aeıioöuü]', '', 'g')) AS vowel_count, {_IPA('left(w, 1)')} AS initial_sound FROM t")
def ipa(spark, d):
    return tokens(spark, d).select("w", W.ipa_report(F.col("w")).alias("r")).select("w", "r.*").withColumn("vowel_count", F.col("vowel_count").cast("long"))


_LAWS = laws("a", "b")


@query(f"WITH {P} SELECT a, b, coalesce(nullif(array_to_string({_LAWS}, '; '), ''), {q(S.NO_LAW)}) AS laws FROM p")
def sound_laws(spark, d):
    return pairs(spark, d).select("a", "b", W.laws_text(F.col("a"), F.col("b")).alias("laws"))


_BROKEN = " || ".join(x for pair in zip(map(q, S.BROKEN_CHAIN.split("{}")), ("a", "b", None), strict=True) for x in pair if x)


@query(f"""WITH {P}, k AS (SELECT a, b, {_LAWS} AS found, {overlap('a', 'b')} AS o FROM p)
SELECT a, b, a = b OR len(found) > 0 OR o >= 0.3 AS is_valid, CASE WHEN a = b THEN 1.0 WHEN len(found) > 0 THEN 0.95 WHEN o >= 0.6 THEN 0.85 WHEN o >= 0.3 THEN 0.75 ELSE 0.2 END::DOUBLE AS score,
 CASE WHEN a = b THEN {q(S.SAME_SOUND)} WHEN len(found) > 0 THEN array_to_string(found, '; ') ELSE {q(S.SKELETON)} END AS rules, CASE WHEN a = b OR len(found) > 0 OR o >= 0.3 THEN '' ELSE {_BROKEN} END AS violations FROM k""")
def chain_verify(spark, d):
    told = pairs(spark, d).select("a", "b", W.chain(F.col("a"), F.col("b")).alias("c"))
    return told.select("a", "b", "c.is_valid", "c.score", F.array_join("c.rules", "; ").alias("rules"), F.array_join("c.violations", "; ").alias("violations"))


@query(f"WITH {T} SELECT w, regexp_replace(translate(regexp_replace(w, '[^{S.ALPHABET_A}]', '', 'g'), '{S.CLASS_FROM}', '{S.CLASS_TO}'), '[^A-Z]', 'X', 'g') AS classes FROM t")
def sound_class(spark, d):
    return tokens(spark, d).select("w", W.sound_classes(F.col("w")).alias("classes"))


_FEATURES = ", ".join(f"({q(k)}, {listed(v)})" for k, v in S.ARTICULATION.items())


@query(f"""WITH f(seg, v) AS (VALUES {_FEATURES}), e AS (SELECT seg, i, v[i] AS x FROM f, range(1, {len(S.FEATURES) + 1}) AS r(i))
SELECT a.seg AS a, b.seg AS b, floor(count(*) FILTER (a.x <> b.x) / CAST(count(*) AS DOUBLE) * 1000 + 0.5) / 1000.0::DOUBLE AS distance
FROM e a JOIN e b USING (i) WHERE a.x <> 0 AND b.x <> 0 GROUP BY a.seg, b.seg""")
def hamming_table(spark, d):
    seg = spark.createDataFrame(list(S.ARTICULATION.items()), "seg string, v array<int>").select("seg", F.posexplode("v").alias("i", "x")).where("x <> 0")
    both = seg.withColumnsRenamed({"seg": "a", "x": "p"}).join(seg.withColumnsRenamed({"seg": "b", "x": "q"}), "i")
    return both.groupBy("a", "b").agg(W.round_n(F.sum((F.col("p") != F.col("q")).cast("int")) / F.count("*"), 3).alias("distance"))


_XY = f"{letters('a', S.ALPHABET_A)} AS x, {letters('b', S.ALPHABET_A)} AS y"


@query(f"WITH {P}, xy AS (SELECT a, b, {_XY} FROM p), {align('xy')} SELECT a, b, raw, similarity, distance, aligned_a, aligned_b FROM xy JOIN al USING (x, y)")
def align_pairs(spark, d):
    both = pairs(spark, d).select("a", "b", W.letters(F.col("a"), S.ALPHABET_A).alias("x"), W.letters(F.col("b"), S.ALPHABET_A).alias("y"))
    return both.withColumn("al", alignment("x", "y")).select("a", "b", "al.*")


@query("SELECT x.n_name AS a, y.n_name AS b, levenshtein(x.n_name, y.n_name) AS distance, floor((1 - levenshtein(x.n_name, y.n_name) / CAST(greatest(length(x.n_name), length(y.n_name)) AS DOUBLE)) * 100 * 10 + 0.5) / 10.0::DOUBLE AS similarity FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name")
def levenshtein_pairs(spark, d):
    x, y = (read(spark, d, "nation").select("n_regionkey", F.col("n_name").alias(c)) for c in "ab")
    both = x.join(y, "n_regionkey").where("a < b").select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"))
    return both.withColumn("similarity", W.round_n((1 - F.col("distance") / F.greatest(F.length("a"), F.length("b")).cast("double")) * 100, 1))


_B = lambda c: f"regexp_replace({c}, '[^{S.ALPHABET_B}]', '', 'g')"
_two = lambda form, x, y: " || ".join([q(form.split("{}")[0]), x, q(form.split("{}")[1]), y, q(form.split("{}")[2])])
_V = lambda c: f"regexp_replace({c}, '[^aeıioöuü]', '', 'g')"


@query(f"""WITH {P}, k AS (SELECT a, b, {letters('a', S.ALPHABET_B)} AS s, {letters('b', S.ALPHABET_B)} AS t FROM p),
l AS (SELECT a, b, s, t, CASE WHEN s = '' OR t = '' OR s = t THEN [] ELSE list_filter([CASE WHEN left(s, 1) <> left(t, 1) THEN {{'r': 'INITIAL_' || upper(left(s, 1)) || '_' || upper(left(t, 1)), 'p': '#' || left(s, 1) || ' -> #' || left(t, 1), 'o': 'initial', 'd': {_two(S.LAW_INITIAL, 'left(s, 1)', 'left(t, 1)')}}} END,
 CASE WHEN right(s, 1) <> right(t, 1) THEN {{'r': 'FINAL_' || upper(right(s, 1)) || '_' || upper(right(t, 1)), 'p': right(s, 1) || '# -> ' || right(t, 1) || '#', 'o': 'final', 'd': {_two(S.LAW_FINAL, 'right(s, 1)', 'right(t, 1)')}}} END,
 CASE WHEN {_V('s')} <> '' AND {_V('t')} <> '' AND {_V('s')} <> {_V('t')} THEN {{'r': 'VOWEL_SHIFT', 'p': {_V('s')} || ' -> ' || {_V('t')}, 'o': 'medial', 'd': {_two(S.LAW_VOWELS, _V('s'), _V('t'))}}} END], lambda x: x IS NOT NULL) END AS l FROM k)
SELECT a, b, {', '.join(f"coalesce(array_to_string(list_transform(l, lambda x: x.{k}), '; '), '') AS {name}" for k, name in (('r', 'rules'), ('p', 'patterns'), ('o', 'positions'), ('d', 'descriptions')))},
 CASE WHEN s = '' OR t = '' OR s = t THEN 1.0 WHEN len(l) > 0 THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence FROM l""")
def law_induction(spark, d):
    told = pairs(spark, d).select("a", "b", W.law_structs(F.col("a"), F.col("b")).alias("l"), W.induction(F.col("a"), F.col("b"))["confidence"].alias("confidence"))
    return told.select("a", "b", *[F.array_join(f"l.{k}", "; ").alias(n) for k, n in (("rule_id", "rules"), ("pattern", "patterns"), ("position", "positions"), ("description", "descriptions"))], "confidence")


@query(f"""WITH {T}, m AS (SELECT w, {FOREIGN} AS f, {_STRIP} AS s FROM t), h AS (SELECT w, f, CASE WHEN s LIKE 'h%' THEN 'k' || s[2:] WHEN s LIKE 'd%' THEN 't' || s[2:] ELSE s END AS s FROM m),
i AS (SELECT *, instr(s, 'l') AS l, instr(s, 'r') AS r FROM h),
j AS (SELECT w, f, '*' || CASE WHEN f THEN w WHEN l > 0 AND l < r THEN left(s, l - 1) || 'r' || substring(s, l + 1, r - l - 1) || 'l' || s[r + 1:] ELSE s END AS form FROM i)
SELECT w, form, NOT f AS reconstructible, CASE WHEN f THEN {q(S.NOT_RECONSTRUCTED)} ELSE {_two(S.RECONSTRUCTED, 'w', 'form')} END AS notes FROM j""")
def proto_forms(spark, d):
    return tokens(spark, d).select("w", W.reconstruction(F.col("w")).alias("r")).select("w", "r.*")


@query(f"""WITH {T}, {_LEXICON}, b AS (SELECT w, {_B('w')} AS y FROM t), e AS (SELECT headword, count(*) FILTER (length({letters('word', S.ALPHABET_B)}) >= 2) AS n FROM x GROUP BY headword),
f AS (SELECT w, y, coalesce(n, 0) AS n, CASE WHEN y = '' THEN '' ELSE '*' || translate(left(y, 1), 'ktm', 'gdb') || regexp_replace(y[2:], '[zs]$', 'ŕ') END AS form FROM b LEFT JOIN e ON e.headword = b.w)
SELECT w, form, CASE WHEN y = '' THEN 0.0 WHEN n > 1 THEN 0.88 ELSE 0.75 END::DOUBLE AS confidence, CASE WHEN y = '' THEN '' ELSE {q('; '.join(S.UNATTESTED_RULES))} END AS rules, CASE WHEN y = '' THEN {q(S.UNATTESTED_EMPTY)} ELSE {_two(S.UNATTESTED_NOTES, 'y', 'form')} END AS notes FROM f""")
def proto_unattested(spark, d):
    """Unattested forms of all document words, surer where a dictionary has entries of the word."""
    own = lexicon.entries(spark).groupBy("headword").agg(F.collect_list(F.struct("word")).alias("entries"))
    met = tokens(spark, d).join(F.broadcast(own), F.col("w") == F.col("headword"), "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<word:string>>")))
    told = met.select("w", W.unattested_report(F.col("w"), F.col("entries")).alias("r")).select("w", "r.*")
    return told.withColumn("rules", F.array_join("rules", "; "))


_ERAS = ["{}", "M.Ö. {}", "{} yılı Orhun", "11. yüzyıl Divan", "Cumhuriyet", "Öz Türkçe"]
_ORDERS = f"o AS (SELECT o_orderkey, replace({listed(_ERAS)}[1 + o_orderkey % {len(_ERAS)}], '{{}}', CAST(year(o_orderdate) AS VARCHAR)) AS x FROM orders), k AS (SELECT * FROM o)"


def _eras(spark, d):
    era = F.element_at(W.strings(_ERAS), (F.col("o_orderkey") % len(_ERAS) + 1).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", F.replace(era, F.lit("{}"), F.year("o_orderdate").cast("string")).alias("x"))


@query(f"WITH {_ORDERS} SELECT o_orderkey, {year('x')} AS year FROM k")
def year_parse(spark, d):
    return _eras(spark, d).select("o_orderkey", W.year(F.col("x")).alias("year"))


@query(f"WITH {_ORDERS} SELECT o_orderkey, coalesce({year('x')} <= 1074, true) AS valid FROM k")
def time_lock(spark, d):
    return _eras(spark, d).select("o_orderkey", W.time_lock(F.col("x"), F.lit("11. yy Divan 1074")).alias("valid"))


_GRAMS = r"""g AS (SELECT item_id, gram, count(*) AS f FROM (SELECT item_id, unnest(list_concat([w], list_concat(
  list_transform(range(1, length(w)), lambda i: substring(w, i, 2)), list_concat(list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)), list_transform(range(1, length(w) - 2), lambda i: substring(w, i, 4)))))) AS gram
 FROM (SELECT item_id, unnest(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+')) AS w FROM benchmark) WHERE w <> '') GROUP BY item_id, gram)"""


@query(f"WITH {_GRAMS} SELECT item_id, gram, f AS n FROM g")
def ngram_tf(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.explode(W.ngrams(F.col("text"))).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("n"))


@query(f"""WITH {_GRAMS}, s AS (SELECT item_id, ('0x' || substr(md5(gram), 1, 8))::BIGINT % 64 AS dim, sum(1 + ln(f)) AS x FROM g GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY 1)
SELECT item_id, CAST(dim AS INT) AS dim, floor(x / norm * 10000 + 0.5) / 10000.0::DOUBLE AS weight FROM s JOIN n USING (item_id)""")
def hash_vector(spark, d):
    return R.gram_weights(read(spark, d, "benchmark"), "item_id", "text")


@query(f"""WITH m AS (SELECT item_id, text, reverse(text) AS other FROM benchmark), mp AS (SELECT text AS old, other AS new FROM m), {drift('mp')},
k AS (SELECT item_id, coalesce(distance, 0.0::DOUBLE) AS distance FROM m LEFT JOIN dd ON dd.old = m.text AND dd.new = m.other)
SELECT item_id, distance, {rounded('distance * 1.10::DOUBLE', 3)} AS acceleration, {rounded('distance * 1.10::DOUBLE', 3)} <= 0.85 AS plausible FROM k""")
def meaning_drift(spark, d):
    both = read(spark, d, "benchmark").select("item_id", "text", F.reverse(F.col("text")).alias("other"))
    return R.drift(both, "item_id", "text", "other")


@query("SELECT x.vec_id, floor((1 - greatest(0, least(1, list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))))) * 10000 + 0.5) / 10000.0::DOUBLE AS distance FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def embedding_cosine(spark, d):
    x = read(spark, d, "embeddings").select("vec_id", "embedding")
    y = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return x.join(y, "vec_id").select("vec_id", W.cosine_distance(F.col("embedding"), F.col("next")).alias("distance"))


_BARE = r"regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g')"
_UNTAG = lambda c: rf"regexp_replace(regexp_replace({c}, '(?s)<[^>]+>', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_PLAIN = lambda c: rf"trim(regexp_replace(regexp_replace({c}, '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_FURNISHED = " OR ".join(f"contains(lower(x), {q(k)})" for k in S.FURNITURE)


@query(rf"""WITH b AS (SELECT page_id, {_BARE} AS h FROM pages),
k AS (SELECT page_id, h, list_transform(regexp_extract_all(h, '(?is)<(?:p|article|blockquote|div[^>]*class="[^"]*content[^"]*")[^>]*>(.*?)</(?:p|article|blockquote|div)>', 1)[1:10], lambda x: {_UNTAG('x')}) AS l FROM b)
SELECT page_id, left(CASE WHEN len(l) > 0 THEN {_PLAIN("array_to_string(list_filter(l, lambda x: length(x) >= 30 AND NOT (" + _FURNISHED + ")), ' ')")} ELSE {_PLAIN('h')} END, 2500) AS text FROM k""")
def html_text(spark, d):
    return read(spark, d, "pages").select("page_id", W.html_text(F.col("html")).alias("text"))


@query(rf"SELECT page_id, {_PLAIN('html')} AS text FROM pages")
def html_plain(spark, d):
    return read(spark, d, "pages").select("page_id", W.plain_text(F.col("html")).alias("text"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, d):
    return read(spark, d, "events").select(F.from_json("props", "k long")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


_NOTES = ["bkz. göz; bknz. Köz ve [-> herkil-2]", "[ -> su ] bkz. su", "urfa ağzı", "Kırım -> deniz", ""]
_NOTED = f"n AS (SELECT c_custkey, {listed(_NOTES)}[1 + c_custkey % {len(_NOTES)}] || ' ' || c_name AS x FROM customer)"


def _notes(spark, d):
    note = F.element_at(W.strings(_NOTES), (F.col("c_custkey") % len(_NOTES) + 1).cast("int"))
    return read(spark, d, "customer").select("c_custkey", F.concat(note, F.lit(" "), F.col("c_name")).alias("x"))


_REFS = "flatten([" + ", ".join(f"regexp_extract_all(x, {q('(?i)' + p)}, 1)" for p in S.REFERENCES) + "])"


@query(f"""WITH {_NOTED}, k AS (SELECT c_custkey, list_transform({_REFS}, lambda r: lower(r)) AS r FROM n)
SELECT c_custkey, coalesce(array_to_string(list_filter(r, lambda v, i: length(v) >= 2 AND list_position(r, v) = i), ' '), '') AS refs FROM k""")
def xref_extract(spark, d):
    return _notes(spark, d).select("c_custkey", F.array_join(W.references(F.col("x")), " ").alias("refs"))


@query(f"""WITH {_NOTED}, k AS (SELECT c_custkey, x, CASE {' '.join(f"WHEN contains(lower(x), {q(p[0].lower())}) THEN {i}" for i, p in enumerate(S.PLACES, 1))} END AS i FROM n)
SELECT c_custkey, coalesce({listed(p[0] for p in S.PLACES)}[i], trim(x)) AS location, coalesce({listed(p[1] for p in S.PLACES)}[i], {q(S.NO_REGION)}) AS region, CAST({listed(p[2] for p in S.PLACES)}[i] AS DOUBLE) AS lat, CAST({listed(p[3] for p in S.PLACES)}[i] AS DOUBLE) AS lon FROM k""")
def geo_tag(spark, d):
    return _notes(spark, d).select("c_custkey", W.region(F.col("x")).alias("r")).select("c_custkey", "r.*")


_ENTRIES = r"""e AS (SELECT DISTINCT ON (w, lang, source) w AS query_word, lang AS lang_code, source AS lang_name, w AS word, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 7 = 0 THEN 'Online x' ELSE source END AS meaning,
 CAST(substring(source, 4) AS INT) AS priority, doc_id AS ordinal FROM (SELECT doc_id, lang, source, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS w FROM documents) WHERE w <> '' ORDER BY doc_id)"""


def entries(spark, d):
    """Documents as pseudo-entries: for each word, language and source the first document's."""
    each = read(spark, d, "documents").select("doc_id", "lang", "source", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    one = each.groupBy("w", "lang", "source").agg(F.min("doc_id").alias("ordinal"))
    meaning = F.when(F.col("ordinal") % 3 == 0, "").when(F.col("ordinal") % 7 == 0, "Online x").otherwise(F.col("source"))
    return one.select(F.col("w").alias("query_word"), F.col("lang").alias("lang_code"), F.col("source").alias("lang_name"), F.col("w").alias("word"), meaning.alias("meaning"), F.substring("source", 4, 9).cast("int").alias("priority"), "ordinal")


@query(f"WITH {_ENTRIES} SELECT query_word, lang_code, word, lang_name, meaning, f.p AS priority, f.o AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY query_word, lang_code, word ORDER BY (meaning = '' OR starts_with(meaning, 'Online')), priority, ordinal) AS r, min({{'p': priority, 'o': ordinal}}) OVER (PARTITION BY query_word, lang_code, word) AS f FROM e) WHERE r = 1")
def merge_dedupe(spark, d):
    return R.merge_entries(entries(spark, d))


@query(f"""WITH {_ENTRIES}, n AS (SELECT query_word, count(DISTINCT nullif(lang_name, '')) AS languages, count(DISTINCT nullif(lang_code, '')) AS codes FROM e GROUP BY 1), r AS (SELECT *, floor(languages / 25.0::DOUBLE * 100 + 0.5) / 100.0::DOUBLE AS x FROM n)
SELECT query_word, languages, codes, least(x, 1.0)::DOUBLE AS ratio, floor((85.0::DOUBLE + least(x * 15.0::DOUBLE, 15.0::DOUBLE)) * 10 + 0.5) / 10.0::DOUBLE AS score, CASE WHEN x >= 0.6 THEN {q(S.SPREADS[0][1])} WHEN x >= 0.25 THEN {q(S.SPREADS[1][1])} ELSE {q(S.SPREADS[2][1])} END AS assessment FROM r""")
def spread(spark, d):
    return R.spread_by_word(entries(spark, d))


@query(f"WITH {_ENTRIES} SELECT query_word, array_to_string(list_sort(list_distinct(list(lang_name))), ' ') AS sources FROM e GROUP BY 1")
def sources_agg(spark, d):
    return entries(spark, d).groupBy("query_word").agg(F.array_join(F.array_sort(F.collect_set("lang_name")), " ").alias("sources"))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def store_upsert(spark, d):
    all_of = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return R.upsert(all_of.where("turn % 2 = 0"), all_of.where("turn % 2 = 1"), "conv_id", "turn")


def _words_of(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    w, some = F.lower("c_name"), F.col("c_custkey") % 3 == 0
    told = [F.when(some, F.lit(S.LOAN_KIND)).alias("hypothesis_type"), F.array(F.repeat("c_name", F.lit(3)), F.col("n_name")).alias("attestations"), F.array(w, F.reverse(w)).alias("cognates")]
    return c.select(w.alias("word"), F.concat(F.lit("*"), F.lower("n_name")).alias("root"), *told, F.when(some, F.col("n_name")).alias("donor_language"), F.when(some, 0.5).alias("confidence"))


_CN = "c AS (SELECT lower(c_name) AS w, c_name, lower(n_name) AS r, n_name, c_custkey % 3 = 0 AS known FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_SOME = lambda x, other: f"CASE WHEN known THEN {x} ELSE {other} END"
_PROPS = lambda **kv: "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in kv.items()) + " || '}'"
_QUOTED = lambda x: f"'\"' || {x} || '\"'"
_LIST_OF = {
    "node_id": "'word_' || w, 'proto_' || r, 'case_' || w, 'att_' || w || '_0', 'att_' || w || '_1', 'cog_' || w || '_0', 'cog_' || w || '_1'",
    "kind": "'Word', 'ProtoForm', 'Case', 'Attestation', 'Attestation', 'Cognate', 'Cognate'",
    "label": f"w, '*' || r, {q(S.CASE_LABEL)} || left({_SOME(q(S.LOAN_KIND), q(S.CASE_DEFAULT))}, 25), left(repeat(c_name, 3), 30), left(n_name, 30), w, reverse(w)",
    "properties": ", ".join([
        _PROPS(word=_QUOTED("w"), lang=q('"tr"')), _PROPS(word=_QUOTED("'*' || r"), lang=_QUOTED(_SOME("n_name", q(S.NATIVE_DONOR)))),
        _PROPS(confidence_score=_SOME("'0.5'", "'0.9'"), donor_language=_QUOTED(_SOME("n_name", q(S.NATIVE_DONOR)))),
        _PROPS(record=_QUOTED("repeat(c_name, 3)")), _PROPS(record=_QUOTED("n_name")), _PROPS(word=_QUOTED("w")), _PROPS(word=_QUOTED("reverse(w)"))]),
}
_NODES = f"nodes AS (SELECT w AS word, {', '.join(f'unnest([{v}]) AS {k}' for k, v in _LIST_OF.items())} FROM c)"
_RELATIONS = ["DERIVED_FROM", "HAS_CASE", "ATTESTED_IN", "ATTESTED_IN", "COGNATE_OF", "COGNATE_OF"]
_EDGES = f"""e AS (SELECT w AS word, unnest(['proto_' || r, 'word_' || w, 'word_' || w, 'word_' || w, 'proto_' || r, 'proto_' || r]) AS source,
 unnest(['word_' || w, 'case_' || w, 'att_' || w || '_0', 'att_' || w || '_1', 'cog_' || w || '_0', 'cog_' || w || '_1']) AS target, unnest({listed(_RELATIONS)}) AS relation, unnest({listed(S.EDGE_LABELS[r] for r in _RELATIONS)}) AS label FROM c),
edges AS (SELECT word, 'edge_' || source || '_' || target AS edge_id, source, target, relation, label FROM e)"""


@query(f"WITH {_CN}, {_NODES} SELECT * FROM nodes")
def graph_nodes(spark, d):
    return R.graph_nodes(_words_of(spark, d)).withColumn("properties", F.to_json("properties"))


@query(f"WITH {_CN}, {_EDGES} SELECT * FROM edges")
def graph_edges(spark, d):
    return R.graph_edges(_words_of(spark, d))


_DATA = lambda **kv: "'{\"data\":' || " + _PROPS(**kv) + " || '}'"


@query(f"""WITH {_CN}, {_NODES}, {_EDGES}, j AS (SELECT word, 0 AS o, {_DATA(node_id=_QUOTED('node_id'), kind=_QUOTED('kind'), label=_QUOTED('label'), properties='properties')} AS x FROM nodes
UNION ALL SELECT word, 1, {_DATA(edge_id=_QUOTED('edge_id'), source=_QUOTED('source'), target=_QUOTED('target'), relation=_QUOTED('relation'), label=_QUOTED('label'))} FROM edges)
SELECT word, '[' || string_agg(x, ',' ORDER BY o, x) || ']' AS elements FROM j GROUP BY word""")
def graph_elements(spark, d):
    words = _words_of(spark, d)
    return R.graph_elements(R.graph_nodes(words), R.graph_edges(words))


@query(f"WITH {_CN}, {_NODES}, {_EDGES} SELECT word, count(*) FILTER (n = 1) AS node_count, count(*) FILTER (n = 0) AS edge_count FROM (SELECT word, 1 AS n FROM nodes UNION ALL SELECT word, 0 FROM edges) GROUP BY word")
def graph_counts(spark, d):
    words = _words_of(spark, d)
    return R.graph_counts(R.graph_nodes(words), R.graph_edges(words))


def _forms(spark, d):
    return read(spark, d, "nation").select(F.col("n_name").alias("word"), F.concat(F.lit("*"), F.lower("n_name")).alias("root"), F.col("n_nationkey").alias("position"), F.col("n_regionkey").cast("string").alias("lang_code"), F.lower("n_name").alias("form"))


@query("SELECT 'form_' || (n_nationkey + 1) AS id, CAST(n_regionkey AS VARCHAR) AS language_id, 'param_' || n_name AS parameter_id, lower(n_name) AS form, lower(n_name) AS value, array_to_string(string_split(lower(n_name), ''), ' ') AS segments FROM nation")
def cldf_forms(spark, d):
    return R.cldf_forms(_forms(spark, d))


@query("SELECT 'cog_' || (n_nationkey + 1) AS id, 'form_' || (n_nationkey + 1) AS form_id, 'cogset_*' || lower(n_name) AS cognateset_id, lower(n_name) AS alignment, 'lexichron' AS source FROM nation")
def cldf_cognates(spark, d):
    return R.cldf_cognates(_forms(spark, d))


@query("SELECT n_name AS word, '1.2' AS cldf_version, 'http://cldf.clld.org/v1.0/terms.rdf#Wordlist' AS conforms_to, 'Wordlist - ' || n_name AS title FROM nation")
def cldf_metadata(spark, d):
    return R.cldf_metadata(_forms(spark, d))


@query("SELECT conv_id, turn, role FROM conversations ORDER BY turn DESC, conv_id DESC")
def store_list(spark, d):
    return R.stored_list(read(spark, d, "conversations").select("conv_id", "turn", "role"), "turn", "conv_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def store_orphans(spark, d):
    return R.orphans(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels").select("doc_id"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def store_cascade(spark, d):
    return R.surviving(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels").select("doc_id"), "doc_id")


@query(f"WITH {T}, {CLASSIFIED}, l AS (SELECT DISTINCT quality, w FROM (SELECT quality, unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) AS w FROM documents JOIN labels USING (doc_id)) WHERE w <> '') SELECT quality, classification, count(*) AS words FROM l JOIN c USING (w) GROUP BY quality, classification")
def labels_quality_loan(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    words = docs.select("quality", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''").distinct()
    return words.select("quality", W.classify(F.col("w"))["classification"].alias("classification")).groupBy("quality", "classification").agg(F.count("*").alias("words"))


_BY_PAIR = "h AS (SELECT a || '>' || b AS id, b AS word, '*' || a AS origin, 'Proto-Türkçe M.Ö. 500' AS donor, 'kök ' || a AS proof, b AS meaning, '8. yüzyıl' AS attestation FROM p)"


@query(f"WITH {P}, {_BY_PAIR}, {oracle.referee('h')} SELECT id, word, frm AS origin, similarity, sound_valid, sound, time_valid, sense, cognate, status, confidence FROM verdict")
def referee(spark, d):
    p = pairs(spark, d)
    h = p.select(F.concat("a", F.lit(">"), "b").alias("id"), F.col("b").alias("word"), F.concat(F.lit("*"), F.col("a")).alias("origin"), F.lit("Proto-Türkçe M.Ö. 500").alias("donor"), F.concat(F.lit("kök "), F.col("a")).alias("proof"), F.col("b").alias("meaning"), F.lit("8. yüzyıl").alias("attestation"))
    return R.referee(h)


# each entry's word as the origin of its headword, and of the headword read backwards, by three donors and records
_CLAIMS = [("Proto-Türkçe M.Ö. 500", "8. yüzyıl Orhun"), ("Fransızca (1950 üretimi)", "735 Orhun"), ("Arapça", "")]
_BY_ENTRY = f"""h AS (SELECT headword || '/' || a || '/' || k || '/' || z AS id, CASE WHEN z = 1 THEN reverse(headword) ELSE headword END AS word, '*' || a AS origin, {listed(c[0] for c in _CLAIMS)}[k] AS donor, CASE WHEN k = 3 THEN '' ELSE 'kök ' || a END AS proof, headword AS meaning, {listed(c[1] for c in _CLAIMS)}[k] AS attestation
 FROM (SELECT DISTINCT lower(word) AS a, headword FROM x), range(1, 4) AS r(k), range(0, 2) AS s(z))"""
_REPORT = "badge, score_percentage, array_to_string(rules, '; ') AS rules, array_to_string(violations, '; ') AS violations, raw, aligned_a, aligned_b, time_violation, sense_reason, len(forms) AS cognate_count, array_to_string(forms[1:6], ' ') AS sample_cognates, array_to_string(rejection_reasons, '; ') AS rejection_reasons"


@query(f"WITH {_LEXICON}, {_BY_ENTRY}, {oracle.referee('h')} SELECT id, word, status, confidence, {_REPORT} FROM verdict")
def referee_report(spark, d):
    """The whole report, with stages and reasons, on good and bad claims about every dictionary entry."""
    p = head_pairs(spark).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(1))))
    pick = lambda i: F.element_at(W.strings([c[i] for c in _CLAIMS]), F.col("k"))
    own = [F.concat_ws("/", "b", "a", F.col("k").cast("string"), F.col("z").cast("string")).alias("id"), F.when(F.col("z") == 1, F.reverse("b")).otherwise(F.col("b")).alias("word"), F.concat(F.lit("*"), F.col("a")).alias("origin")]
    h = p.select(*own, pick(0).alias("donor"), F.when(F.col("k") == 3, "").otherwise(F.concat(F.lit("kök "), F.col("a"))).alias("proof"), F.col("b").alias("meaning"), pick(1).alias("attestation"))
    told = R.referee(h, report=True)
    joined = {c: F.array_join(c, "; ") for c in ("rules", "violations", "rejection_reasons")} | {"sample_cognates": F.array_join("sample_cognates", " ")}
    return told.withColumns(joined).select("id", "word", "status", "confidence", "badge", "score_percentage", "rules", "violations", "al.raw", "al.aligned_a", "al.aligned_b", "time_violation", "sense_reason", "cognate_count", "sample_cognates", "rejection_reasons")


_SCRIPT = "coalesce(script, CASE WHEN regexp_matches(word, '[Ѐ-ӿ]') THEN 'Cyrillic' WHEN regexp_matches(word, '[؀-ۿ]') THEN 'Arabic' WHEN regexp_matches(word, '[Ͱ-Ͽ]') THEN 'Greek' ELSE 'Latin' END)"


@query(f"WITH {_LEXICON} SELECT headword, source, priority, ordinal, lang_code, lang_name, word, meaning, {_SCRIPT} AS script FROM x")
def lexicon_entries(spark, d):
    return lexicon.entries(spark)


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in lexicon.root_rows()) + ") AS t(headword, source, priority, proto, meaning, notes)")
def lexicon_roots(spark, d):
    return lexicon.roots(spark)


@query(f"WITH {_LEXICON} SELECT headword, source, ordinal, CASE {' '.join('WHEN ' + ' OR '.join(f'contains(lang_name, {q(k)})' for k in keys) + f' THEN {q(text)} || word' + (chr(32) + '|| chr(32) || chr(45) || chr(32) || left(meaning, 60)' if i == 0 else '') for i, (keys, text) in enumerate(S.TIMELINE))} END AS line FROM x")
def timeline_lines(spark, d):
    return lexicon.entries(spark).select("headword", "source", "ordinal", F.get(W.timeline(F.array(F.struct("lang_name", "word", "meaning"))), F.lit(0)).alias("line"))


@query(f"WITH {T}, c AS (SELECT w, replace(translate(w, '{S.CYRILLIC_FROM}', '{S.CYRILLIC_TO}'), 'c', '{S.CYRILLIC_C}') AS x FROM t) SELECT w, " + "replace(" * sum(len(v) > 1 for v in S.CYRILLIC_LATIN.values()) + "translate(x, " + q("".join(k for k, v in S.CYRILLIC_LATIN.items() if len(v) == 1) + "ъь") + ", " + q("".join(v for v in S.CYRILLIC_LATIN.values() if len(v) == 1)) + ")" + "".join(f", {q(k)}, {q(v)})" for k, v in S.CYRILLIC_LATIN.items() if len(v) > 1) + " AS latin FROM c")
def to_latin(spark, d):
    return tokens(spark, d).select("w", W.to_latin(W.to_cyrillic(F.col("w"))).alias("latin"))


_SENSES = ["{{lb|x}} [[Water]] and ", "a [[sea]] / ocean ", "Online ", " [[plain]] ", "{{gloss}} the soul of "]


@query(f"WITH m AS (SELECT c_custkey, {listed(_SENSES)}[1 + c_custkey % {len(_SENSES)}] || c_name AS x FROM customer) SELECT c_custkey, {translated('x')} AS meaning FROM m")
def meaning_translate(spark, d):
    sense = F.element_at(W.strings(_SENSES), (F.col("c_custkey") % len(_SENSES) + 1).cast("int"))
    return read(spark, d, "customer").select("c_custkey", W.translate_meaning(F.concat(sense, F.col("c_name"))).alias("meaning"))


@query(f"""WITH {P}, k AS (SELECT a, b, list_filter([CASE WHEN starts_with(a, 'k') AND starts_with(b, 'h') THEN {q(S.CHANGES[0])} END, CASE WHEN starts_with(a, 't') AND starts_with(b, 'd') THEN {q(S.CHANGES[1])} END,
 CASE WHEN (contains(a, 'r') AND contains(b, 'l')) OR (contains(a, 'l') AND contains(b, 'r')) THEN {q(S.CHANGES[2])} END], lambda x: x IS NOT NULL) AS n FROM p)
SELECT a, b, {edits('a', 'b')} AS levenshtein, {rounded("(1 - CAST(" + edits('a', 'b') + " AS DOUBLE) / greatest(length(a), length(b), 1)) * 100", 1)} AS similarity, CASE WHEN len(n) > 0 THEN array_to_string(n, '; ') ELSE {q(S.NO_CHANGE)} END AS changes FROM k""")
def sound_changes(spark, d):
    a, b = F.col("a"), F.col("b")
    distance = F.levenshtein(a, b).cast("long")
    longest = F.greatest(F.length(a), F.length(b), F.lit(1)).cast("double")
    return pairs(spark, d).select("a", "b", distance.alias("levenshtein"), W.round_n((1 - distance.cast("double") / longest) * 100, 1).alias("similarity"), F.array_join(W.change_names(a, b), "; ").alias("changes"))


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(q(x) for x in (h, c, w)) + ")" for h, (_, _, own) in lexicon.COGNATES.items() for c, (w, _) in own.items()) + ") AS t(headword, lang_code, word)")
def lexicon_cognates(spark, d):
    return lexicon.entries(spark).where("source = 'cognates'").select("headword", "lang_code", "word")
