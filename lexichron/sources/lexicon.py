"""Embedded dictionaries as tables: roots and entries of headwords, with a source's priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as W
from . import dictionaries as D

# Language codes and names.
LANGUAGES = {
    "otk": "Eski Türkçe", "tr": "Türkiye Türkçesi", "az": "Azerbaycan Türkçesi", "kk": "Kazakça", "uz": "Özbekçe", "tk": "Türkmençe", "ky": "Kırgızca", "tt": "Tatarca", "ug": "Uygurca",
    "cv": "Çuvaşça", "sah": "Saha / Yakutça", "ba": "Başkurtça", "gag": "Gagavuzca", "krc": "Karaçay-Balkarca", "tyv": "Tuva Türkçesi", "alt": "Altay Türkçesi", "khk": "Hakasça", "chg": "Çağatayca",
}
# Reconstructed roots, their meanings, and cognates by language (word; meaning).
COGNATES = {
    "ayak": ("*adak / *adaq", "foot / leg / step", {
        "otk": ("adak / adaq", "ayak, adak"), "tr": ("ayak", "vücudun yürüme organı, ayak"), "az": ("ayaq", "ayak"), "kk": ("аяқ (ayaq)", "ayak"), "uz": ("oyoq", "ayak"), "tk": ("aýak", "ayak"),
        "ky": ("аяк (ayak)", "ayak"), "tt": ("аяк (ayaq)", "ayak"), "ug": ("ئاياق (ayaq)", "ayak"), "cv": ("ура (ura)", "ayak (Oğur r-dili kayması)"), "sah": ("атах (atax)", "ayak (Saha t-dili kayması)"),
        "ba": ("аяҡ (ayaq)", "ayak"), "tyv": ("аяк (ayak)", "ayak"), "khk": ("азах (azaq)", "ayak (Hakas z-dili kayması)")}),
    "su": ("*sub", "water / liquid / stream", {
        "otk": ("sub / suv", "su, akarsu"), "tr": ("su", "su, sıvı"), "az": ("su", "su"), "kk": ("су (su)", "su"), "uz": ("suv", "su"), "tk": ("suw", "su"), "ky": ("суу (suu)", "su"), "tt": ("су (su)", "su"),
        "ug": ("سۇ (su)", "su"), "cv": ("шыв (šəv)", "su"), "sah": ("уу (uu)", "su"), "ba": ("һыу (hıw)", "su"), "tyv": ("суг (suğ)", "su")}),
    "göz": ("*göŕ", "eye / sight", {
        "otk": ("göz / kör-", "göz, görmek"), "tr": ("göz", "görüş organı, göz"), "az": ("göz", "göz"), "kk": ("kөз (köz)", "göz"), "uz": ("ko'z", "göz"), "tk": ("göz", "göz"), "ky": ("көз (köz)", "göz"),
        "tt": ("күз (küz)", "göz"), "ug": ("كۆز (köz)", "göz"), "cv": ("куҫ (kuś)", "göz"), "sah": ("көс (kös)", "göz, bakış"), "ba": ("күз (küz)", "göz")}),
    "el": ("*el / *elig", "hand / forearm / hold", {
        "otk": ("elig", "el"), "tr": ("el", "tutma organı, el"), "az": ("əl", "el"), "kk": ("қол / елік", "el"), "uz": ("qo'l / el", "el"), "tk": ("el", "el"), "ky": ("кол / эл", "el"), "tt": ("кул / ил", "el"),
        "ug": ("ئەل (el)", "el"), "cv": ("алӑ (ală)", "el"), "sah": ("ilii (ilii)", "el")}),
    "deniz": ("*teŋiz", "sea / large lake / ocean", {
        "otk": ("teŋiz", "deniz, büyük göl"), "tr": ("deniz", "büyük su kütlesi, deniz"), "az": ("dəniz", "deniz"), "kk": ("теңіз (teŋiz)", "deniz"), "uz": ("dengiz", "deniz"), "tk": ("deňiz", "deniz"),
        "ky": ("деңиз (deŋiz)", "deniz"), "tt": ("тиңез (tiŋez)", "deniz"), "ug": ("دەڭىز (deŋiz)", "deniz"), "cv": ("тинӗс (tinĕs)", "deniz"), "sah": ("тиңис (tiŋis)", "deniz")}),
}
# Names and notes of donor entries.
DONOR_ENTRY, DONOR_NOTE = "Kaynak Dil Etimolojisi ({})", "[{}] Orijinal İmla: {} | Kaynak Anlam: {} | Kendi İçi Etimoloji: {} | Geçiş Yörüngesi: {}"
COGNATE_PRIORITY, NATIONAL_PRIORITY = 14, 9
# National dictionaries and their rows (headword: code, word, meaning).
NATIONAL_NAMES = {
    "az": "Azerbaycan Obastan / Azleks İzahlı Lüğəti", "uz": "Özbekistan Savodxon / ZiyoNET İzoqli Lug'ati", "kk": "Kazakistan Tilqazyna / Sozlik.kz Sözдіgі", "ky": "Kırgızistan ElSözlük İzahlı Sözlüğü", "tt": "Tataristan Tatarica İzahlı Sözlüğü",
}
NATIONAL = {
    "deniz": [("az", "dəniz", "Böyük su hövzəsi, dəniz"), ("uz", "dengiz", "Dengiz, katta suv havzasi"), ("kk", "теңіз", "Теңіз, үлкен су айдыны"), ("ky", "деңиз", "Деңиз, чоң суу"), ("tt", "тиңез", "Тиңез, зур су мәйданы")],
    "su": [("az", "su", "Şəffaf maye, su"), ("uz", "suv", "Suv, hayot manbai"), ("kk", "су", "Су, мөлдір сұйықтық"), ("ky", "суу", "Суу, өмүр булагы"), ("tt", "су", "Су, сыеклык")],
    "göz": [("az", "göz", "Görmə organı, göz"), ("uz", "ko'z", "Ko'rish a'zosi, ko'z"), ("kk", "көз", "Көру мүшесі, көз"), ("ky", "көз", "Көрүү мүчөсү, көз"), ("tt", "күз", "Күрү әгъзасы, күз")],
    "kut": [("az", "qut", "Bərəkət, səadət, bəxt"), ("uz", "qut", "Qut, baraka, omad"), ("kk", "құт", "Құт, береке, ырыс"), ("ky", "кут", "Кут, ырыс, жан"), ("tt", "кот", "Кот, бәхет, җан")],
}
#: Each dictionary's place in the order in which sources are believed.
#: Sources whose pages are parsed stand among them.
PARSED = {"books": 4, "journals": 5, "ottoman": 6, "terms": 7, "dialects": 7, "names": 7, "translations": 8, "portal": 13, "etymological": 15, "general": 16, "historical_scan": 17, "compilation": 18, "word_page": 19, "reconstruction": 19, "definitions": 21, "encyclopaedia": 3}
PRIORITIES = {"academic": 1, "historical": 2, "encyclopaedia": 3, "ottoman": 6, "national": NATIONAL_PRIORITY, "donors": 10, "books": 11, "notes": 12, "cognates": COGNATE_PRIORITY}
ENTRY = "headword string, source string, priority int, ordinal int, lang_code string, lang_name string, word string, meaning string, script string"
ROOT = "headword string, source string, priority int, proto string, meaning string, notes string"
NOTE_LENGTH = 180


def entry_rows() -> list[tuple]:
    """(headword, source, priority, ordinal, lang_code, lang_name, word, meaning, script) of all dictionaries; a null script follows from the word."""
    found: list[tuple] = []

    def add(source: str, headword: str, rows: list[tuple]) -> None:
        found.extend((headword, source, PRIORITIES[source], i, *r) for i, r in enumerate(rows))

    for h, (_, _, _, own) in D.ACADEMIC.items():
        add("academic", h, [(c, LANGUAGES[c], w, m, None) for c, (w, m) in own.items()])
    for h, texts in D.HISTORICAL.items():
        add("historical", h, [(c, name, h, text, kind) for (c, name, kind), text in zip(D.HISTORICAL_WORKS, texts, strict=True)])
    for h, text in D.ENCYCLOPAEDIA.items():
        add("encyclopaedia", h, [("otk", D.ENCYCLOPAEDIA_NAME, h, text, "Latin")])
    for h, (w, m) in D.OTTOMAN.items():
        add("ottoman", h, [("ota", D.OTTOMAN_NAME, w, m, "Arabic")])
    for h, own in NATIONAL.items():
        add("national", h, [(c, NATIONAL_NAMES[c], w, m, None) for c, w, m in own])
    for h, (lang, w, m, inner, _) in D.DONORS.items():
        add("donors", h, [("donor", DONOR_ENTRY.format(lang), w, f"Kaynak Anlamı: {m} | Kendi İçi Türeyiş: {inner}", None)])
    for h, own in D.BOOKS.items():
        add("books", h, [("otk", f"Yerel PDF Kitap Taraması (Sayfa {page})", h, f"Kitap: {book} | Metin: {text}", "Latin") for book, page, text in own])
    for h, own in D.NOTES.items():
        add("notes", h, [("otk", D.NOTES_NAME, h, " | ".join(own)[:NOTE_LENGTH] + "...", "Latin")])
    for h, (_, _, own) in COGNATES.items():
        add("cognates", h, [(c, LANGUAGES[c], w, m, None) for c, (w, m) in own.items()])
    return found


def root_rows() -> list[tuple]:
    """(headword, source, priority, proto, meaning, notes) of the dictionaries that say something of a root."""
    rows = [("academic", h, p, m, n) for h, (p, m, n, _) in D.ACADEMIC.items()]
    rows += [("encyclopaedia", h, "", "", text) for h, text in D.ENCYCLOPAEDIA.items()]
    rows += [("ottoman", h, "", "", f"Osmanlıca Lügat Kaydı: {m}") for h, (_, m) in D.OTTOMAN.items()]
    rows += [("donors", h, "", "", DONOR_NOTE.format(lang, w, m, inner, way)) for h, (lang, w, m, inner, way) in D.DONORS.items()]
    rows += [("books", h, "", "", f"Metin İçi Kitap Kaydı: {own[-1][0]} (s. {own[-1][1]})") for h, own in D.BOOKS.items()]
    rows += [("notes", h, "", "", " | ".join(own)) for h, own in D.NOTES.items()]
    rows += [("cognates", h, p, m, f"Starling / Tower of Babel Proto-Turkic reconstruction {p}") for h, (p, m, _) in COGNATES.items()]
    return [(h, s, PRIORITIES[s], p, m, n) for s, h, p, m, n in rows]


def entries(spark: SparkSession) -> DataFrame:
    """All entries of all dictionaries, in each one's order."""
    return spark.createDataFrame(entry_rows(), ENTRY).withColumn("script", F.coalesce("script", W.script(F.col("word"))))


def roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(root_rows(), ROOT)


def donor_rows() -> list[tuple]:
    """(headword, donor_language, origin_form, etymology, donor_meaning) of known loanwords."""
    return [(h, lang, w, inner, f"Kaynak Anlamı: {m} | Geçiş Yörüngesi: {way}") for h, (lang, w, m, inner, way) in D.DONORS.items()]


def donors(spark: SparkSession) -> DataFrame:
    """The rows of :func:`donor_rows`."""
    return spark.createDataFrame(donor_rows(), "headword string, donor_language string, origin_form string, etymology string, donor_meaning string")


def asked(words: DataFrame) -> DataFrame:
    """(query_word, variant, headword): what to look up for each ``query_word``, in order: itself, its stem, its other forms."""
    variants = F.array_distinct(F.concat(F.array("query_word", W.strip_suffixes(F.col("query_word"))["stem"]), W.variants(F.col("query_word"))))
    return words.select("query_word", F.posexplode(variants).alias("variant", "headword"))


def probe(words: DataFrame, spark: SparkSession) -> DataFrame:
    """Entries whose headword is a variant of a ``query_word``: one broadcast join for all words, variants and dictionaries."""
    return asked(words).join(F.broadcast(entries(spark)), "headword").drop("headword")


def met_roots(words: DataFrame, spark: SparkSession) -> DataFrame:
    """(query_word, variant, priority, proto, meaning) of all roots whose headword is a variant of a ``query_word``."""
    return asked(words).join(F.broadcast(roots(spark)), "headword").select("query_word", "variant", "priority", "proto", "meaning")


def first_roots(met: DataFrame) -> DataFrame:
    """(query_word, proto, root_meaning): the first that isn't empty, by source and then by variant."""
    ordered = met.withColumn("order", F.struct("priority", "variant"))
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("order")))
    return ordered.groupBy("query_word").agg(first("proto").alias("proto"), first("meaning").alias("root_meaning"))


def probe_roots(words: DataFrame, spark: SparkSession) -> DataFrame:
    return first_roots(met_roots(words, spark))
