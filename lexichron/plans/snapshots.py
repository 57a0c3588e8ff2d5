"""Queries of the page parsers: pages made of customers, and the raw pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import words as W
from ..sources import parsers as P
from ..sources.lexicon import LANGUAGES
from .oracle import listed, q
from .registry import query, read

#: Bodies by source, {n} standing for a customer's name and {k} for its key; and the entries that they give.
MADE = {
    "terms": ('[{"sozcuk":"{n}","anlam":"m {k}"},{"anlam":""},{"anlam":"late"}]', [("tr", "TDK Akademik Terim (TDK Terim Sözlüğü)", "{n}", "m {k}")]),
    "dialects": ('[{"kence":"{n}","anlam":"m {k}","il_adi":"Urfa"},{"anlam":"x"}]', [("tr", "TDK Türkiye Türkçesi Ağızları (Urfa)", "{n}", "m {k}"), ("tr", "TDK Türkiye Türkçesi Ağızları (Anadolu Ağızları)", "{w}", "x")]),
    "names": ('[{"ad":"{n}","anlam":"m {k}","cinsiyet":"E"}]', [("tr", "TDK Kişi Adları Etimolojisi (E)", "{n}", "m {k}")]),
    "compilation": ('[{"madde":"{n}","anlam":"m {k}","sehir":""},{"anlam":"n","sehir":"Bor"}]', [("tr", "Türk Ağızları", "{n}", "m {k}"), ("tr", "Türk Ağızları (Bor)", "{w}", "n")]),
    "historical_scan": ('[{"tarama":[{"kelime":"{n}","anlam":"m {k}"},{"kelime":"z"}]}]', [("otk", "Tarihi Türkçe / Osmanlıca (13.-19. yy)", "{n}", "m {k}")]),
    "general": ('[{"lisan":"Farsça","anlamlarList":[{"anlam":"a"},{"x":1},{"anlam":"{n}"},{"anlam":"c"}]}]', [("tr", LANGUAGES["tr"], "{w}", "a; {n}")]),
    "books": ('{"response":{"docs":[{"title":"{n}","creator":"c","year":"1950"},{"creator":"d"},{"title":"T"}]}}', [("otk", "Archive.org Kitap Külliyatı (1950)", "{w}", "Kitap: {n} (Yazar: c)"), ("otk", "Archive.org Kitap Külliyatı (Tarihsiz)", "{w}", "Kitap: T (Yazar: Bilinmeyen Yazar)")]),
    "translations": ('{"tuc":[{"phrase":{"text":"{n}"}},{"phrase":null},{"phrase":{"text":"z"}}]}', [("az", "Glosbe Azerbaycan Türkçesi Karşılığı", "{n}", "Glosbe online çeviri kaydı ({w})")]),
    "journals": ('<a class="x card-title" href="#"><i>{n}</i></a><a class="card-title">doğrulayınız</a><a class="card-title">Üç</a>', [("tr", "DergiPark Akademik Makale Dizin", "{w}", "Makale Başlığı: {n}")]),
    "encyclopaedia": ("<p>kısa kök</p><p class='a'>Bu <b>{n}</b> Eski Türkçe metinlerde uzun uzun geçer.</p>", [("otk", "TDV İSAM Ansiklopedisi Metin Analizi", "{w}", "Bu  {n}  Eski Türkçe metinlerde uzun uzun geçer.")]),
    "ottoman": ('<div class="big meaning">\n<b>{n}</b>, ab</div>', [("ota", "Kubbealtı Lugatı (Lugatim.com Live)", "{w}", "{n}, ab")]),
    "portal": ("<p>a</p><p>Ana Türkçe *sub “water” <i>ve</i>  Eski Türkçe suv “{n}” sözü</p>", [("otk", "Eski Türkçe (Uygur & DLT Tanıklamaları)", "suv", "{n}")]),
    "etymological": ('text:"Eski Türkçe suv “{n}” ",text:"Farsça ab “su”"', [("otk", LANGUAGES["otk"], "suv", "{n}")]),
    "word_page": ("{{inh|tr|trk-pro|*sub|t=water}}\n==Eski==\n# [[{n}]]\n==Qqqq==\n# x\n", [("otk", LANGUAGES["otk"], "{w}", "{n}")]),
    "definitions": ('{"Kazakça":[{"definition":"<b>{n}</b>"}],"Klingon":[{"definition":"x"}]}', [("kk", LANGUAGES["kk"], "{w}", "{n}")]),
    "reconstruction": ("==Proto-Turkic==\n# [[{n}]]\n{{desc|tr|su}}\n{{desc|az|su|t=x}}\n{{desc|ky|sw|x|ts=suu}}\n{{desc|zz|q}}\n{{desc|tr|suv}}", [("tr", LANGUAGES["tr"], "su", "{n}"), ("az", LANGUAGES["az"], "su", "{n}"), ("ky", LANGUAGES["ky"], "sw (suu)", "{n}")]),
    "unknown": ("{n}", []),
}
#: Root fields of the sources that tell any.
ROOTS = {
    "encyclopaedia": ("", "", "TDV İSAM: Bu  {n}  Eski Türkçe metinlerde uzun uzun geçer...."),
    "portal": ("*sub", "water", "EtimolojiTürkçe: Ana Türkçe *sub “water” ve Eski Türkçe suv “{n}” sözü"),
    "general": ("", "a; {n}", "TDK Köken Bilgisi: Farsça"),
    "etymological": ("[Farsça] ab", "{n}", "Nişanyan Alıntı Kaynağı: Farsça 'ab' (su)"),
    "word_page": ("*sub", "water", ""),
    "reconstruction": ("", "{n}", ""),
}


def _filled(template):
    return F.replace(F.replace(template, F.lit("{n}"), F.col("c_name")), F.lit("{k}"), F.col("c_custkey").cast("string"))


def _parsed(spark, d):
    """The pages of each customer, parsed. The customers are dealt out first: a file of few MB is one task's, and makes many times its size of pages."""
    bodies = F.explode(F.array(*[F.struct(F.lit(k).alias("source_id"), _filled(F.lit(b)).alias("body")) for k, (b, _) in MADE.items()])).alias("s")
    dealt = read(spark, d, "customer").select("c_custkey", "c_name").repartition(4 * spark.sparkContext.defaultParallelism)
    made = dealt.select(F.lower("c_name").alias("headword"), bodies).select("headword", "s.*")
    return P.parse(made)


_put = lambda c: f"replace(replace(replace({c}, '{{n}}', c_name), '{{k}}', CAST(c_custkey AS VARCHAR)), '{{w}}', lower(c_name))"
_ROWS = ", ".join("(" + ", ".join(map(q, (k, i, *e))) + ")" for k, (_, own) in MADE.items() for i, e in enumerate(own))


@query(f"WITH v(source_id, position, lang_code, lang_name, word, meaning) AS (VALUES {_ROWS}) SELECT lower(c_name) AS headword, source_id, position, lang_code, lang_name, {_put('word')} AS word, {_put('meaning')} AS meaning, 'Latin' AS script FROM customer, v")
def parse_entries(spark, d):
    """The entries of a page of each source for each customer."""
    each = F.posexplode_outer("entries").alias("position", "e")  # the inner kind makes Spark infer a filter that parses every page once more
    return _parsed(spark, d).select("headword", "source_id", each).where("position is not null").select("headword", "source_id", "position", "e.*")


_ROOT_ROWS = ", ".join("(" + ", ".join(map(q, (k, *ROOTS.get(k, ("", "", ""))))) + ")" for k in MADE)


@query(f"WITH v(source_id, proto, meaning, notes) AS (VALUES {_ROOT_ROWS}) SELECT lower(c_name) AS headword, source_id, proto, {_put('meaning')} AS meaning, {_put('notes')} AS notes FROM customer, v")
def parse_roots(spark, d):
    """What the same pages tell of the root."""
    return _parsed(spark, d).select("headword", "source_id", "proto", "meaning", "notes")


_UNTAGGED = r"trim(regexp_replace(regexp_replace({}, '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_URL_TEXT = _UNTAGGED.format(r"regexp_replace(regexp_replace(html, '(?s)<script.*?>.*?</script>', '', 'g'), '(?s)<style.*?>.*?>', '', 'g')")


@query(f"SELECT page_id, left({_URL_TEXT}, 2500) AS text FROM pages")
def url_text(spark, d):
    return read(spark, d, "pages").select("page_id", P.url_text(F.col("html")).alias("text"))


@query()
def parse_pages(spark, d):
    """Every raw page, parsed as a page of each source of HTML."""
    html = read(spark, d, "pages")
    kinds = F.explode(W.strings(["encyclopaedia", "journals", "ottoman", "portal", "etymological", "word_page"])).alias("source_id")
    found = P.parse(html.select(kinds, F.col("url").alias("headword"), F.col("html").alias("body")))
    return found.withColumn("entries", F.to_json("entries"))


_NOTE_BODY = '{"histories":{h},"firstAttestation":"{n} 1303","etym":{"language":"{l}","word":"{n}"}}'
_STARTS = ["fener ", "su "]


@query(rf"""WITH c AS (SELECT c_custkey, c_name, {listed(_STARTS)}[1 + c_custkey % 2] || lower(c_name) AS w, c_custkey % 3 = 0 AS told, c_custkey % 5 = 0 AS lent FROM customer),
s AS (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN {" || ".join([q(P.FOREIGN_START.split("{}")[0]), "'f'", q(P.FOREIGN_START.split("{}")[1])])} ELSE {q(P.NATIVE_START)} END AS start FROM c)
SELECT c_custkey, 'Tarihsel Tanıklama Kaydı [' || w || ']: ' || CASE WHEN told THEN 'DLT 1074' ELSE c_name || ' 1303' END AS attestation,
 CASE WHEN lent THEN start || ' Nişanyan Canlı Doğrulama: [Arapça] ''' || c_name || ''' sözcüğünden alıntıdır.' ELSE start || ' Canlı kaynak dil taraması yapılıyor.' END AS donor,
 CASE WHEN told THEN 'DergiPark Akademik Makaleler: ' || c_name || ' | Bir' ELSE '''' || w || ''' için DergiPark ve TÜBİTAK akademik dizini canlı taranmıştır.' END AS articles FROM s""")
def parse_notes(spark, d):
    """Sentences on attestations, donors and articles, from answers made of customers."""
    told, lent = F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 5 == 0
    w = F.concat(F.element_at(W.strings(_STARTS), (F.col("c_custkey") % 2 + 1).cast("int")), F.lower("c_name"))
    body = F.replace(F.replace(F.replace(F.lit(_NOTE_BODY), F.lit("{h}"), F.when(told, '"DLT 1074"').otherwise('""')), F.lit("{l}"), F.when(lent, "Arapça").otherwise("")), F.lit("{n}"), F.col("c_name"))
    page = F.when(told, F.concat(F.lit('<h3 class="article-title"><a>'), "c_name", F.lit('</a></h3><H3 class="article-title">Bir</H3>'))).otherwise("")
    made = read(spark, d, "customer").select("c_custkey", w.alias("w"), body.alias("b"), page.alias("p"))
    return made.select("c_custkey", P.attestation_note(F.col("w"), F.col("b")).alias("attestation"), P.donor_note(F.col("w"), F.col("b")).alias("donor"), P.article_note(F.col("w"), F.col("p")).alias("articles"))


_TITLE, _PAGE = "nisanyansozluk.com", "dergipark.org.tr"


@query(f"""WITH c AS (SELECT c_custkey, lower(c_name) AS w, c_name, c_custkey % 2 = 0 AS a, c_custkey % 3 = 0 AS b FROM customer)
SELECT c_custkey, CASE WHEN a THEN '{_TITLE}' ELSE '' END || CASE WHEN a AND b THEN ' ' ELSE '' END || CASE WHEN b THEN '{_PAGE}' ELSE '' END AS domains,
 CASE WHEN a THEN 'Köken: ' || c_name || ' | Tarihçe: 1303' ELSE '' END || CASE WHEN a AND b THEN ' ' ELSE '' END || CASE WHEN b THEN c_name ELSE '' END AS contents FROM c""")
def trusted_pages(spark, d):
    """What the trusted dictionary and the journals say, from pages made of customers."""
    one = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('<div class="etym x"><b>'), "c_name", F.lit('</b></div><div class="hist">1303</div>'))).otherwise("")
    two = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('<a class="card-title">'), "c_name", F.lit('</a><a class="card-title">doğrulayınız</a><a class="card-title">late</a>'))).otherwise("")
    found = read(spark, d, "customer").select("c_custkey", P.trusted_pages(F.lower("c_name"), one, two).alias("t"))
    return found.select("c_custkey", F.array_join(F.transform("t", lambda x: x["domain"]), " ").alias("domains"), F.array_join(F.transform("t", lambda x: x["content"]), " ").alias("contents"))


_LINES = ["[Turkish] {n}", "[Turkish] b", "[Ottoman Turkish] d"]


@query(f"""SELECT c_custkey, {' || '.join([q('[Turkish] '), 'c_name', q(' | [Turkish] b | [Ottoman Turkish] d')])} AS lines, '[Ottoman Turkish] d' AS old,
 'https://tr.wiktionary.org/wiki/a+b Wiktionary: a b ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN ' | https://tr.wikipedia.org/wiki/c Vikipedi: c s' ELSE ' | https://x.org/' || c_custkey || ' ' || c_name || ' etimolojisi ' || c_name || ' etimolojisi etimolojik sözlük ve dilbilim kaydı.' END AS hits FROM customer""")
def web_hits(spark, d):
    """Definition lines, lines on old texts, and web hits with their fall-backs, from answers made of customers."""
    n, even = F.col("c_name"), F.col("c_custkey") % 2 == 0
    put = lambda text: F.replace(F.lit(text), F.lit("{n}"), n)
    lines = P.definition_lines(put('{"Turkish":[{"definition":"<i>{n}</i>"},{"definition":"b"},{"definition":"c"}],"Ottoman Turkish":[{"definition":"d"}],"French":[{"definition":"e"}]}'))
    wiki = put('{"query":{"search":[{"title":"a b","snippet":"<b>{n}</b>"}]}}')
    other = F.when(even, '{"query":{"search":[{"title":"c","snippet":"s"}]}}').otherwise("{")
    links = F.concat(F.lit('<a class="r" href="https://x.org/'), F.col("c_custkey").cast("string"), F.lit('"><b>'), n, F.lit('</b> etimolojisi</a><a href="y">other words here</a>'))
    found = read(spark, d, "customer").select("c_custkey", lines.alias("l"), P.web_hits(F.lower("c_name"), wiki, other, F.lit("Bulunamadı"), links).alias("h"))
    return found.select("c_custkey", F.array_join("l", " | ").alias("lines"), F.array_join(P.corpus_lines(F.col("l")), " | ").alias("old"), F.array_join(F.transform("h", lambda h: F.concat_ws(" ", h["url"], h["title"], h["snippet"])), " | ").alias("hits"))


@query()
def web_enriched(spark, d):
    """Hits made of the raw pages' urls, each with its page's text."""
    pages = read(spark, d, "pages").where("url is not null")
    one = F.struct("url", F.lit("t").alias("title"), F.lit("s").alias("snippet"))
    return P.enriched(pages.select(F.col("page_id").cast("string").alias("headword"), F.array(one).alias("hits")), pages.select("url", "html").dropDuplicates(["url"]))


_CHAIN_WORD, _CHAIN_ROOT = "{{inh|tr|trk-pro|*r{k}|t=}}\n==Eski==\n# [[{n}]]\n==Kazak==\n# [[z]]\n", "==Proto-Turkic==\n# [[{n}]]\n{{desc|kk|su}}\n{{desc|cv|sw}}"


@query(f"""WITH v(position, known, lang_code, lang_name, word, meaning) AS (VALUES (0, true, 'kk', {q(LANGUAGES['kk'])}, 'su', '{{n}}'), (1, true, 'cv', {q(LANGUAGES['cv'])}, 'sw', '{{n}}'), (2, true, 'otk', {q(LANGUAGES['otk'])}, '{{w}}', '{{n}}'),
 (0, false, 'otk', {q(LANGUAGES['otk'])}, '{{w}}', '{{n}}'), (1, false, 'kk', {q(LANGUAGES['kk'])}, '{{w}}', 'z'))
SELECT lower(c_name) AS headword, '*r' || c_custkey AS proto, position, lang_code, lang_name, {_put('word')} AS word, {_put('v.meaning')} AS meaning FROM customer, v WHERE known = (c_custkey % 2 = 0)""")
def wiki_chain(spark, d):
    """Word pages chained with the pages of the roots that they link, where there is one."""
    c = read(spark, d, "customer")
    words = c.select(F.lower("c_name").alias("headword"), _filled(F.lit(_CHAIN_WORD)).alias("body"))
    roots = c.where("c_custkey % 2 = 0").select(F.concat(F.lit(P.ROOT_PAGE + "r"), F.col("c_custkey").cast("string")).alias("title"), _filled(F.lit(_CHAIN_ROOT)).alias("body"))
    found = P.word_and_root_pages(words, roots)
    return found.select("headword", "proto", F.posexplode("entries").alias("position", "e")).select("headword", "proto", "position", "e.lang_code", "e.lang_name", "e.word", "e.meaning")
