"""Golden values of the word operators, and every query against its SQL on the smallest tables."""

import importlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from lexichron.functions import words as W
from lexichron.functions.alignment import align
from lexichron.operators import relational as R
from lexichron.plans import findings, registry, snapshots  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, f, *args):
    row = spark.range(1).select(f(*[F.lit(a) for a in args]).alias("x")).first()
    return row.x


@pytest.mark.parametrize(("word", "stem"), [("güzellik", "güzel"), ("kitaplardan", "kitaplar"), ("yağmurluk", "yağmur"), ("kurtarılmak", "kurtarıl")])
def test_strip(spark, word, stem):
    assert one(spark, W.strip_suffixes, word).stem == stem


@pytest.mark.parametrize(("word", "stem", "affixes"), [("kitaplardan", "kitap", ["-lar", "-dan"]), ("bilgisizlik", "bil", ["-gi", "-siz", "-lik"]), ("gözlükçülük", "gözlükçü", ["-lük"])])
def test_segment(spark, word, stem, affixes):
    assert tuple(one(spark, W.segment, word)) == (stem, affixes)


@pytest.mark.parametrize(("a", "b", "raw", "sim", "x", "y"), [("sub", "su", 4, 0.556, "sub", "su-"), ("teŋiz", "deniz", 13, 0.907, "teŋiz", "deniz"), ("sous", "su", 2, 0.333, "sous", "s-u-"), ("göŕ", "göz", 7, 0.862, "göŕ", "göz"), ("xyzq", "göz", -1, 0.267, "xyzq", "göz-")])
def test_align(a, b, raw, sim, x, y):
    got = align(a, b)
    assert (got[0], got[1], got[3], got[4]) == (raw, sim, x, y)


@pytest.mark.parametrize(("text", "year"), [("11. yüzyıl Divanü Lugati't-Türk", 1050), ("735 yılı Orhun", 735), ("Proto-Türkçe M.Ö. 500", -500), ("Fransızca", 1850), ("Öz Türkçe", None)])
def test_year(spark, text, year):
    assert one(spark, W.year, text) == year


@pytest.mark.parametrize(("word", "p"), [("göz", 1.0), ("kitap", 1.0), ("herkil", 0.158), ("vakit", 0.059), ("tren", 0.143), ("jimnastik", 0.043), ("psikoloji", 0.034)])
def test_classify(spark, word, p):
    assert one(spark, W.classify, word).p_native == p


def test_candidates(spark):
    assert set(one(spark, W.candidates, "ev")) == {"ev", "iv", "äv", "əv", "ев", "ив", "әв"}


def test_proto(spark):
    assert [one(spark, W.unattested_form, w) for w in ("korak", "göz", "tuz", "men")] == ["*gorak", "*göŕ", "*duŕ", "*ben"]
    assert [one(spark, W.proto_form, w) for w in ("deniz", "halk", "elri", "güzellik")] == ["*teniz", "*halk", "*erli", "*güzel"]


def test_referee(spark):
    rows = [("a", "göz", "*göŕ", "Proto-Türkçe M.Ö. 500", "kök", "göz", "8. yüzyıl Orhun Yazıtları (kös)"), ("b", "su", "sous", "Fransızca (1950 üretimi)", "x", "su", "735 Orhun"), ("c", "göz", "xyzq", "", "x", "y", "")]
    got = {r.id: r for r in R.referee(spark.createDataFrame(rows, "id string, word string, origin string, donor string, proof string, meaning string, attestation string")).collect()}
    assert got["a"].status in ("VALIDATED", "NEEDS_REVIEW") and got["a"].confidence >= 0.70
    assert got["b"].status == "REJECTED" and got["b"].confidence <= 0.30
    assert got["c"].confidence < 0.50


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    for c in columns:
        if got[c].dtype.kind in "iuf":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    key = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert key(got).equals(key(want))


def test_entry_imports():
    assert importlib.import_module("__spark_entry__").queries()


def test_search(spark):
    from lexichron.plans.search import finding_json, search

    words = spark.createDataFrame([(" Su ",), ("göz",), ("xyz",), ("kitap",), ("tetik",), ("",)], "query_word string")
    found = search(words, spark).cache()
    got = {r.query_word: r for r in found.collect()}
    assert set(got) == {"su", "göz", "xyz", "kitap", "tetik"}
    assert got["su"].proto_root == "*sub" and {"otk", "tr", "az", "kk", "ota", "chg"} <= {e.lang_code for e in got["su"].entries}
    assert got["su"].entries[0].lang_code == "otk" and got["su"].root_meaning == "su, sıvı" and len(got["su"].cognates) == 12
    assert got["su"].sources == ["academic", "books", "cognates", "encyclopaedia", "historical", "national", "notes", "ottoman"]
    assert any(t.startswith("14. YY") for t in got["su"].timeline)
    assert got["tetik"].root_meaning == "uyanık, tetikte, keskin"
    assert got["kitap"].proto_root == "[Arapça] كتاب (kitāb)" and got["kitap"].entries[0].script == "Original"
    assert "donor table (Arapça)" in got["kitap"].sources
    assert got["xyz"].entries == [] and got["xyz"].assessment == "Veri Katmanında Karşılık Bulunamadı" and got["xyz"].proto_root.startswith("*xy")
    texts = {r.query_word: json.loads(r.finding) for r in finding_json(found).collect()}
    assert texts["su"]["entries"][0]["word"] and "phonetic_shift" in texts["kitap"]["entries"][0]


def test_long_words_stay_whole(spark):
    tail = "ka" * 1500
    assert one(spark, W.proto_form, "d" + tail + "k") == "*t" + tail + "k"
    assert one(spark, W.proto_form, "al" + tail + "r" + tail + "k") == "*ar" + tail + "l" + tail + "k"
    assert one(spark, W.unattested_form, "k" + tail + "z") == "*g" + tail + "ŕ"


def test_search_analyses(spark):
    from lexichron.functions.alignment import align
    from lexichron.functions.drift import distance
    from lexichron.plans.search import finding_json, search

    words = spark.createDataFrame([("su",), ("xyz",), ("kitap",), ("fener",)], "query_word string")
    got = {r.query_word: json.loads(r.finding) for r in finding_json(search(words, spark)).collect()}
    roots = {"su": "sub", "xyz": got["xyz"]["unattested"]["origin"][1:], "kitap": got["kitap"]["unattested"]["origin"][1:], "fener": "fener"}
    for w, root in roots.items():
        f, a = got[w], got[w]["alignment"]
        assert (a["score"], a["similarity"], a["distance"], a["aligned_source"], a["aligned_target"]) == align(root, w)
        assert len(a["source_classes"]) == len(root) and set(f["probabilities"]) == {"p_native", "p_arabic_persian", "p_greek_latin", "p_western", "n_violations", "violations"}
        assert f["reconstruction"]["reconstructible"] == (w != "fener") and f["reconstruction"]["form"].startswith("*")
        assert f["unattested"]["attestation"] and f["unattested"]["status"] and f["graph"]["node_count"] == len(f["graph"]["nodes"]) == 1 + f["graph"]["edge_count"]
        assert {n["node_id"] for n in f["graph"]["nodes"]} >= {e[k] for e in f["graph"]["edges"] for k in ("source", "target")}
    assert got["su"]["drift"]["distance"] == distance("su, sıvı", "su") and got["su"]["induced_laws"] == {"rules": ["FINAL_B_U"], "confidence": 0.95}
    assert got["su"]["hypothesis"] != got["su"]["unattested"] and got["xyz"]["hypothesis"] == got["xyz"]["unattested"]
    assert got["fener"]["induced_laws"] == {"rules": [], "confidence": 1.0} and not got["fener"]["donor_match"]["found"]
    assert got["kitap"]["donor_match"]["found"] and got["kitap"]["donor_match"]["donor_language"] == "Arapça"
    assert "proto_[Arapça] كتاب (kitāb)" in {n["node_id"] for n in got["kitap"]["graph"]["nodes"]}


def test_search_with_pages(spark):
    from lexichron.plans.search import search

    words = spark.createDataFrame([("su",), ("qqq",)], "query_word string")
    pages = [("terms", "qqq", '[{"sozcuk":"qqq","anlam":"salt"}]'), ("word_page", "qqq", "{{inh|tr|trk-pro|*kuk|t=salt}}\n==Eski==\n# [[tuz]]\n"), ("portal", "qqq", "<p>nothing</p>"), ("terms", "su", '[{"sozcuk":"su","anlam":"H2O"}]')]
    got = {r.query_word: r for r in search(words, spark, spark.createDataFrame(pages, "source_id string, headword string, body string")).collect()}
    assert got["qqq"].sources == ["terms", "word_page"] and got["qqq"].proto_root == "*kuk" and [e.lang_code for e in got["qqq"].entries] == ["otk", "tr"]
    assert "terms" in got["su"].sources and got["su"].proto_root == "*sub" and not any(e.meaning == "H2O" for e in got["su"].entries)  # an earlier source tells this word


def test_bulk_and_store(spark, tmp_path):
    from lexichron.plans.search import bulk
    from lexichron.sources import store

    (tmp_path / "words.txt").write_text("su\n\n  göz \nsu\n", encoding="utf-8")
    folder = str(tmp_path / "store")
    bulk(spark, str(tmp_path / "words.txt"), folder)
    bulk(spark, str(tmp_path / "words.txt"), folder)
    rows = store.listing(spark, folder).collect()
    assert sorted(r.query_word for r in rows) == ["göz", "su"] and store.count(spark, folder).first()[0] == 2
    found = json.loads(store.get(spark, folder, " SU ").first().full_finding_json)
    assert found["proto_root"] == "*sub" and store.get(spark, folder, "yok").isEmpty()
    n = store.entries(spark, folder).where("query_word = 'su'").count()
    assert n == len(found["entries"]) > 5
    store.compact(spark, folder, str(tmp_path / "small"))
    assert store.entries(spark, str(tmp_path / "small")).where("query_word = 'su'").count() == n and store.get(spark, str(tmp_path / "small"), "göz").count() == 1
    plan = store.get(spark, folder, "su")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(query_word,su)" in plan


def test_enriched(spark):
    from lexichron.sources import parsers as P

    hits = spark.createDataFrame([("su", [(f"http://x/{i}", "t", f"s{i}") for i in range(7)] + [("ftp://y", "t", "late")])], "headword string, hits array<struct<url:string,title:string,snippet:string>>")
    pages = spark.createDataFrame([("http://x/0", "<p>" + "uzun metin " * 5 + "</p>"), ("http://x/1", ""), ("ftp://y", "<p>no</p>")], "url string, html string")
    got = {r.place: r.content_summary for r in P.enriched(hits, pages).collect()}
    assert got[0].startswith("uzun metin") and [got[i] for i in (1, 2, 3, 4)] == ["s1", "s2", "s3", "s4"] and len(got) == 5


def test_hypotheses(spark):
    from lexichron.operators import hypotheses as H

    words = spark.createDataFrame([("göz", "*göŕ", "göz"), ("bilimsel", None, None), ("kitap", None, ""), ("herkil", None, None), ("fener", "", "x")], "query_word string, proto string, meaning string")
    got = {r.query_word: r for r in H.native(words, spark).collect()}
    assert {k: r.hypothesis_type.split("(")[1] for k, r in got.items()} == {"göz": "Native Proto-Turkic Hypothesis)", "bilimsel": "Neologism Hypothesis)", "kitap": "Verified Loanword Hypothesis)", "herkil": "Verified Loanword Hypothesis)", "fener": "Dialect/Loanword Hypothesis)"}
    assert got["göz"].origin == "*göŕ" and got["göz"].status in ("VALIDATED", "NEEDS_REVIEW") and all(0 <= r.confidence <= 1 for r in got.values())
    open_ = {r.query_word: r for r in H.unattested(words).collect()}
    assert open_["göz"].origin == "*göŕ" and open_["fener"].origin == "fener" and open_["bilimsel"].origin == "*bilim"


def test_reports(spark):
    assert one(spark, W.classify, "psikoloji").violations == ["Söz başı 'p' harfi Öz Türkçede bulunmaz", "Büyük ünlü uyumsuzluğu", "Batı dili -loji soneki tespit edildi"]
    assert one(spark, W.classify, "tren").violations == ["Söz başı çift ünsüz 'tr' (Batı Alıntısı)"] and one(spark, W.classify, "").p_native == 1.0
    assert one(spark, W.neologism_report, "bilimsel").is_neologism and one(spark, W.neologism_report, "göz") is None
    assert one(spark, W.phonotactic_report, "göz").startswith("Fonotaktik Analiz Temiz") and "; Büyük" in one(spark, W.phonotactic_report, "herkal")
    assert [one(spark, W.suffix_report, w) for w in ("güzellik", "su", "fener", "")] == ["Morfotaktik Analiz: Kök: 'güzel' | Tespit Edilen Ekler: -lik", "Morfotaktik Analiz: 'su' yalın kök yapısındadır.", "Morfotaktik Analiz: 'fener' alıntı veya ağız biçimi olarak yalın yapıdadır.", None]
    assert tuple(one(spark, W.ipa_report, "çağrı")) == ("/tʃɑɰrɯ/", "Tam Uyumlu", 2, "tʃ") and one(spark, W.fixed_reports, "su").alignment.endswith("%88.5.")
    laws = one(spark, W.law_structs, "*teŋiz", "deniz")
    assert [(x.rule_id, x.pattern, x.position) for x in laws] == [("INITIAL_T_D", "#t -> #d", "initial")] and laws[0].description == "Söz başı t- ünsüzünün d- ünsüzüne dönüşmesi"
    assert one(spark, W.chain, "xyzq", "göbek").violations and one(spark, W.chain, "su", "su").violations == []
    both = spark.createDataFrame([("korak", [("qorak",), ("a",), ("gorax",)]), ("korak", [("qorak",)]), ("", [])], "w string, e array<struct<word:string>>")
    assert [tuple(r.x)[:2] for r in both.select(W.unattested_report(F.col("w"), F.col("e")).alias("x")).collect()] == [("*gorak", 0.88), ("*gorak", 0.75), ("", 0.0)]
    entries = spark.createDataFrame([([("Türkçe", "su", "su, sıvı"), ("Kazakça", "су", "Online kayıt"), ("x", "y", "")],)], "e array<struct<lang_name:string,word:string,meaning:string>>")
    assert entries.select(W.evidence(F.col("e")).alias("x")).first().x == ["Türkçe (su): su, sıvı"]


def test_referee_report(spark):
    rows = [("a", "göz", "*göŕ", "Proto-Türkçe M.Ö. 500", "kök", "göz", "8. yüzyıl Orhun Yazıtları (kös)"), ("b", "su", "sous", "Fransızca (1950 üretimi)", "x", "su", "735 Orhun"), ("c", "göz", "xtp", "", "", "y", "")]
    got = {r.id: r for r in R.referee(spark.createDataFrame(rows, "id string, word string, origin string, donor string, proof string, meaning string, attestation string"), report=True).collect()}
    assert got["a"].badge.startswith("🟢") or got["a"].badge.startswith("🟡")
    assert got["b"].badge.startswith("🔴") and "ANAKRONİZM ENGELİ" in got["b"].rejection_reasons[0] and got["b"].score_percentage == "%30.0"
    assert got["c"].rejection_reasons == got["c"].violations and "Broken Phonetic Chain" in got["c"].violations[0] and got["c"].cognate_count > 6 == len(got["c"].sample_cognates)


def test_merge_keeps_the_first_place(spark):
    rows = [("su", "tr", "su", "", 1, 5), ("su", "tr", "su", "water", 9, 0), ("su", "az", "su", "x", 2, 0)]
    got = {r.lang_code: (r.meaning, r.priority, r.ordinal) for r in R.merge_entries(spark.createDataFrame(rows, "query_word string, lang_code string, word string, meaning string, priority int, ordinal int")).collect()}
    assert got == {"tr": ("water", 1, 5), "az": ("x", 2, 0)}


def test_latin(spark):
    assert [one(spark, W.to_latin, w) for w in ("Жұлдыз съ", "су", "كتاب", "Straße")] == ["ZHұldız s", "su", "كtab", "Straße"]


def test_meanings(spark):
    assert [one(spark, W.translate_meaning, w) for w in ("{{lb|tr}} [[water]]", "Online kayıt", " ", "[[taş]]", "{{x}}")] == ["su, sıvı", "Online kayıt", "", "taş", "{{x}}"]


def test_drift_kernel(spark):
    from lexichron.functions.drift import vector

    texts = ["su, sıvı; akarsu", "deniz büyük göl deniz", "teŋiz – 'deniz'  42\tx_y", "a", "", "!!"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = {(r.id, r.dim): r.weight for r in R.gram_weights(rows, "id", "text").collect()}
    for i, text in enumerate(texts):
        assert [table.get((i, d), 0.0) for d in range(64)] == (vector(text) / 10_000).tolist()
    both = spark.createDataFrame([(1, "su", "su"), (2, "su", None), (3, " ", "su"), (4, "abc", "xyz")], "id long, a string, b string")
    got = {r.id: r for r in R.drift(both, "id", "a", "b").collect()}
    assert [got[i].distance for i in (1, 2, 3)] == [0.0, 0.0, 0.0] and got[4].distance > 0.9 and not got[4].plausible
