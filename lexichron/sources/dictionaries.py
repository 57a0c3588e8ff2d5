"""Rows of the embedded dictionaries. All values in this module are fixed: results depend on them letter by letter."""

# Roots, meanings, notes and cognates by language (word; meaning).
ACADEMIC = {
    "ayak": ("*adak / *adaq", "foot / leg / step", "Clauson EDPT p. 45: adak 'foot, leg'. Attested in Orkhon Inscriptions (Kültigin E33: adagın yorıtdı 'ayaklandırdı') and DLT (I, 68). The Famous Turkic d/y/z sound shift (Old Turkic adak -> Common Turkic ayak, Khakas azaq, Yakut atax, Chuvash ura). | Sevortjan ЭСТЯ (I, 66): *adak 'noga, foot'.", {
        "otk": ("adak / adaq", "ayak, yürüme organı (d-dili)"), "tr": ("ayak", "vücudun yürüme organı"), "az": ("ayaq", "ayak"), "kk": ("аяқ (ayaq)", "ayak"), "uz": ("oyoq", "ayak"), "tk": ("aýak", "ayak"),
        "ky": ("аяк (ayak)", "ayak"), "tt": ("аяк (ayaq)", "ayak"), "cv": ("ура (ura)", "ayak (Oğur r-dili kayması)"), "sah": ("атах (atax)", "ayak (Saha t-dili kayması)"), "khk": ("азах (azaq)", "ayak (Hakas z-dili kayması)")}),
    "tetik": ("*tetik / *tät-", "alert, sharp, quick-witted, trigger", "Clauson EDPT p. 451: tetik < tät- (to perceive, understand). Attested in Karakhanid (DLT I, 386) and Chagatai as 'uyanık, çabuk anlayan, keskin zekalı'. | Sevortjan ЭСТЯ (III, 214): *tetik 'bystryj, čutkij, umnyj'. Cognates in Old Turkic, Uzbek (tetik), Kazakh (tetik - trigger mechanism), Turkmen (tetik), Kyrgyz (tetik).", {
        "otk": ("tetik / tät-", "keskin zekalı, uyanık, çabuk kavrayan"), "chg": ("تتیك (tetik)", "uyanık, kıvrak"), "tr": ("tetik", "1. Uyanık, tetikte. 2. Ateşli silahlarda horozu düşüren mekanizma mandalı."),
        "az": ("tətik", "tətiyi çəkmək, mekanizma mandalı"), "kk": ("тетік (tetik)", "glavnyj mehanizm, tetik mandalı"), "uz": ("tetik", "tetik, tetiklik, uyanık ve zinde"), "tk": ("tetik", "tetik mekanızması, tetiklik"),
        "ky": ("тетик (tetik)", "tetik, zinde"), "tt": ("тетик (tetik)", "uyanık, çevik")}),
    "su": ("*sub", "water / liquid", "Clauson EDPT p. 783: sub 'water'. Attested in Orkhon Inscriptions (Kültigin E29: sub 'su'). | Sevortjan ЭСТЯ (VI, 348): *suv ~ *sub 'voda, reka'. Common Turkic *sub.", {
        "otk": ("<ctrl42>𐰆𐰉 (sub)", "su, akarsu"), "tr": ("su", "su"), "az": ("su", "su"), "kk": ("су (su)", "su"), "uz": ("suv", "su"), "tk": ("suw", "su"), "ky": ("суу (suu)", "su"), "tt": ("су (su)", "su"),
        "cv": ("шыв (šəv)", "su"), "sah": ("уу (uu)", "su")}),
    "deniz": ("*teŋiz", "sea / ocean", "Clauson EDPT p. 527: teŋiz 'sea, large lake'. Attested in Orkhon Inscriptions (Tonyukuk 19: teŋiz 'deniz'). | Sevortjan ЭСТЯ (IV, 189): *teŋiz 'more, ozero'.", {
        "otk": ("teŋiz", "deniz, büyük göl"), "tr": ("deniz", "deniz"), "az": ("dəniz", "deniz"), "kk": ("теңіз (teŋiz)", "deniz"), "uz": ("dengiz", "deniz"), "tk": ("deňiz", "deniz"), "ky": ("деңиз (deŋiz)", "deniz"),
        "tt": ("тиңез (tiŋez)", "deniz"), "cv": ("тинӗс (tinĕs)", "deniz"), "sah": ("тиңис (tiŋis)", "deniz")}),
    "kut": ("*kut", "divine favor / majesty / soul / good fortune", "Clauson EDPT p. 594: kut 'heavenly good fortune, blessing, majesty'. Attested in Orkhon Inscriptions (Kültigin N1: Teŋri kutı Türk Kültigin 'Tanrı kutu Türk Kültigin'). | Sevortjan ЭСТЯ (VI, 172): *kut 'blagodat', dusha, sčast'je'.", {
        "otk": ("𐰸𐰆 Auth (kut)", "tanrı lütfu, saadet, kut, can"), "tr": ("kut", "kutsallık, iyi talih, tanrısal güç"), "az": ("qut", "bərəkət, səadət"), "kk": ("құт (qut)", "bereket, kut, uğur"), "uz": ("qut", "kut, baraka"),
        "ky": ("кут (kut)", "kut, dusha"), "tt": ("кот (kot)", "can, kut, uğur"), "sah": ("кут (kut)", "ruh, kut (sur-kut)")}),
}
# The four historical works (language, name, script) and what each says of a headword.
HISTORICAL_WORKS = [
    ("otk", "Divanü Lugati't-Türk (Kaşgarlı Mahmud, 1074)", "Latin / Arabic"), ("ota", "Kamus-ı Türkî (Şemseddin Sami, 1901)", "Latin / Arabic"),
    ("krc", "Codex Cumanicus (Kıpçakça Metinler, 1303)", "Latin"), ("chg", "Sanglax (Klasik Çağatayca Nevai Sözlüğü)", "Latin / Arabic"),
]
HISTORICAL = {
    "tetik": ("Divanü Lugati't-Türk (Kaşgarlı Mahmud, 1074): tetik (تِتِكْ) 'çabuk anlayan, uyanık, çabuk kavrayan adam'. tät- eyleminden.", "Kamus-ı Türkî (Şemseddin Sami, 1901): tetik (تتیك) 'uyanık, zeki, gayretli, silah mekanizması mandalı'.", "Codex Cumanicus (1303 Kıpçakça): tetiq / tetik 'promptus, vigil, uyanık'.", "Sanglax (Çağatayca Nevai Sözlüğü): tetik 'kıvrak, zinde, zeki'."),
    "su": ("Divanü Lugati't-Türk (1074): sub (سُبْ) 'su, akarsu, ırmak'.", "Kamus-ı Türkî (1901): su (صو) 'mayi, sıvı, hayat kaynağı'. Eski Türkçe suv / sub.", "Codex Cumanicus (1303): suv / su 'aqua'.", "Sanglax (Çağatayca): suv / su."),
    "deniz": ("Divanü Lugati't-Türk (1074): teŋiz (تِңِزْ) 'deniz, ulu göl'.", "Kamus-ı Türkî (1901): deniz (دниз) 'büyük su kütlesi, bahr'. Eski Türkçe teŋiz.", "Codex Cumanicus (1303): deŋiz 'mare'.", "Sanglax (Çağatayca): teŋiz / deniz."),
    "göz": ("Divanü Lugati't-Türk (1074): göz (كُؤزْ) 'göz, basar organı'.", "Kamus-ı Türkî (1901): göz (كوز) 'görüş organı, ayn'.", "Codex Cumanicus (1303): küz / göz 'oculus'.", "Sanglax (Çağatayca): köz."),
    "el": ("Divanü Lugati't-Türk (1074): elig (اِلِكْ) 'el, tutma organı' & el (اِلْ) 'halk, vilayet, memleket'.", "Kamus-ı Türkî (1901): el (ايل) 'yed, tutma organı, memleket, yabancı'.", "Codex Cumanicus (1303): el / il 'manus, populus'.", "Sanglax (Çağatayca): elig / el."),
    "belge": ("Divanü Lugati't-Türk (1074): belgü (بِلْكُو) 'nişan, işaret, alamet'.", "Kamus-ı Türkî (1901): belge / belgü 'işaret, alamet, senet, vesika'.", "Codex Cumanicus (1303): belgi / belgü 'signum'.", "Sanglax (Çağatayca): belgi."),
    "bilgi": ("Divanü Lugati't-Türk (1074): biliğ (بِلِكْ) 'akıl, ilim, bilgi'. bil- eyleminden.", "Kamus-ı Türkî (1901): bilgi / biliğ 'ilm, malumat, vukuf'.", "Codex Cumanicus (1303): bilik / bilgi 'scientia'.", "Sanglax (Çağatayca): bilik."),
    "kut": ("Divanü Lugati't-Türk (1074): kut (قُتْ) 'devlet, saadet, uğur, tanrı lütfu'.", "Kamus-ı Türkî (1901): kut (قوت) 'saadet, baht, kutsallık'.", "Codex Cumanicus (1303): kut 'fortuna, gratia'.", "Sanglax (Çağatayca): kut."),
}
# The encyclopaedia's index.
ENCYCLOPAEDIA_NAME = "TDV İSAM Ansiklopedisi (M.Ö. Hun & Orhun Kayıtları)"
ENCYCLOPAEDIA = {
    "tanrı": "TDV İSAM Ansiklopedisi (Cilt 40, s. 473): Doğu Hunları (M.Ö. III. yüzyıl) zamanından itibaren kullanıldığı bilinen ten͡gri kelimesinin kökeniyle ilgili etimolojik sözlüklerde gökyüzü ve ilah karşılığı. Orhun N1: Teŋri kutı Türk Kültigin.",
    "tengri": "TDV İSAM Ansiklopedisi (Cilt 40, s. 473): Doğu Hunları (M.Ö. III. yy) Hunca ten͡gri kelimesi. Orhun Yazıtları teŋri.",
    "kut": "TDV İSAM Ansiklopedisi (Cilt 26, s. 450): Orhun Yazıtları ve Karahanlı metinlerinde kut 'ilahi lütuf, saadet, yönetme yetkisi, devlet gücü'.",
    "su": "TDV İSAM Ansiklopedisi: Eski Türkçe sub / suv. Hayat kaynağı, akarsu, ırmak.",
    "deniz": "TDV İSAM Ansiklopedisi: Eski Türkçe teŋiz. Orhun yazıtlarında teŋiz.",
    "göz": "TDV İSAM Ansiklopedisi: Eski Türkçe köz / göz. Basar organı.",
    "el": "TDV İSAM Ansiklopedisi: Eski Türkçe elig (tutma organı) ve el (memleket, devlet).",
    "ayak": "TDV İSAM Ansiklopedisi: Eski Türkçe adak / adaq. Orhun yazıtlarında adagın yorıtdı.",
}
# The Ottoman dictionary (spelling; meaning).
OTTOMAN_NAME = "Osmanlıca Lügat (Kubbealtı Lugatı & Ahmet Vefik Paşa (Lehçe-i Osmanî))"
OTTOMAN = {
    "deniz": ("دڭز / deniz", "Deniz, umman, büyük su kütlesi. Kubbealtı Lugatı: (Eski Türkçe teŋiz)."),
    "su": ("صو / su", "Su, ma, ab. Kubbealtı Lugatı: (Eski Türkçe sub / suv)."),
    "göz": ("كوز / göz", "Göz, basar, ayn. Kubbealtı Lugatı: (Eski Türkçe göz / köz)."),
    "el": ("يد / el / elig", "1. Tutma organı (Eski Türkçe elig). 2. Devlet, memleket."),
    "ayak": ("ایاق / ayak", "Ayak, kadem. Kubbealtı Lugatı: (Eski Türkçe adak)."),
    "kut": ("قوت / kut", "1. Tanrı lütfu, iyi talih, kut. 2. Can, gıda, azık."),
    "tengri": ("تڭرى / tanrı", "Tanrı, ilah, Huda, Halık. Kubbealtı Lugatı: (Eski Türkçe teŋri)."),
}
# Loanwords (donor language; spelling; meaning there; derivation there; way into the language).
DONORS = {
    "herkil": ("Ermenice (Anadolu Ağızları Alıntısı)", "յարգել / յարգիլ (harkil / hargel)", "Samandan veya çalı çırpıdan yapılan çit, engel, ekin ve tahıl koruma ambarı", "Ermenice յարգ (harg 'çit, samanlık, bölmeli alan') kökünden türetim. Doğu ve Orta Karadeniz (Sinop/Ayancık) ağızlarına Ermenice diyalekt temasıyla girmiştir.", "Eski Ermenice (harg 'çit/samanlık') -> Ermenice (harkil/hargel) -> Karadeniz & Sinop Ağızları (herkil/herkel)"),
    "herkel": ("Ermenice (Anadolu Ağızları Alıntısı)", "յարգել (hargel)", "Ekin ve tahıl ambarı, ahşap saklama bölmesi", "Ermenice յարգ (harg 'çit, samanlık') kökü. Anadolu ağızlarında ünlü daralması ve fonetik kaymayla herkel/herkil biçimini almıştır.", "Ermenice (hargel) -> Karadeniz & Sinop Ağızları (herkel)"),
    "harkil": ("Ermenice (Anadolu Ağızları Alıntısı)", "յարգիլ (hargil)", "Çit, samanlık, ambar bölmesi", "Ermenice յարգ (harg 'samanlık, çit') türevi.", "Ermenice (hargil) -> Anadolu Ağızları (harkil)"),
    "efendi": ("Bizans Grekçesi / Rumca", "αὐθέντης (authéntēs)", "Kendi işini gören, kendi başına karar veren, hakim, buyurucu", "Bizans Grekçesi authéntēs < Eski Grekçe αὐτο- (auto- 'kendi') + ἔντης (éntēs 'yapan/eyleyen'). Osmanlıcaya 14. yüzyılda geçmiştir.", "Eski Grekçe -> Bizans Grekçesi (authéntēs) -> Osmanlıca (افندی / efendi) -> Çağdaş Türkçe"),
    "rüzgar": ("Farsça", "روزگار (rūzgār)", "Zaman, felek, devir, esinti, yel", "Farsça rūzgār < Farsça rūz (روز 'gün, zaman') + -gār (گار yapım ve aidiyet eki). Asıl anlamı 'zaman, devir' iken Türkçede mecazen 'esinti, yel' anlamı kazanmıştır.", "Eski Farsça (raučah) -> Orta Farsça (rōčgār) -> Klasik Farsça (rūzgār) -> Türkçe"),
    "kitap": ("Arapça", "كتاب (kitāb)", "Yazılı şey, defter, mektup, risale, kutsal metin", "Arapça k-t-b (ك-ت-ب 'yazmak') üçlü sami kökünden fi'āl (فِعَال) kalıbında masdar/isim. Aynı kökten: katip, mektup, kütüphane, katibe.", "Proto-Sami (*katab-) -> Arapça (kitāb) -> Karahanlı Türkçe (11. yy) -> Çağdaş Türkçe"),
    "kalem": ("Arapça (Grekçe Alıntısı)", "قلم (qalam) / Grekçe κάλαμος (kálamos)", "Yazı kamışı, yontulmuş kamış", "Arapça qalam < Eski Grekçe kálamos (κάλαμος 'kamış, saz'). Arapçaya Grekçeden geçmiş, Türkçeye 11. yüzyılda Karahanlı döneminde girmiştir.", "Eski Grekçe (kálamos) -> Arapça (qalam) -> Karahanlıca (11. yy) -> Çağdaş Türkçe"),
    "dünya": ("Arapça", "دنيا (dunyā)", "Aşağıda olan, yakın olan yer, yeryüzü, alemi fani", "Arapça d-n-v (د-ن-و 'yakın olmak, alçakta olmak') kökünden fu'lā (فُعْلَى) vezninde ism-i tafdil. Ahirete nispetle 'yakın/aşağı alem'.", "Arapça (dunyā) -> Karahanlıca (11. yy) -> Çağdaş Türkçe"),
    "sümen": ("Fransızca (Macarca Aracılığıyla)", "sous-main / Macarca sujtás", "Masa üstü yazı altlığı, el altı dosyası", "Fransızca sous-main < sous ('altında') + main ('el'). Fransızca el altı matbuası.", "Fransızca (sous-main) -> Macarca -> Osmanlıca -> Türkçe"),
    "televizyon": ("Fransızca (Grekçe + Latince Hibrit)", "télévision", "Uzaktan görüntü aktarım cihazı", "Fransızca télévision < Grekçe tēle (τῆλε 'uzak') + Latince visio ('görme, görüntü'). 20. yüzyıl teknoloji terimi.", "Grekçe + Latince -> Fransızca (télévision) -> Türkçe"),
}
# Snippets of books (book; page; text).
BOOKS = {
    "deniz": [("Sir Gerard Clauson - An Etymological Dictionary of Pre-Thirteenth-Century Turkish (PDF)", 527, "teŋiz 'sea, large lake'. Attested in Orkhon Inscriptions (Tonyukuk 19: teŋiz 'deniz')."), ("E. V. Sevortjan - ÉSTJa Etimologičeskij Slovar' Tjurkskikh Jazykov Vol. IV (PDF)", 189, "*teŋiz 'more, ozero, sea'. Common Turkic.")],
    "su": [("Sir Gerard Clauson - An Etymological Dictionary of Pre-Thirteenth-Century Turkish (PDF)", 783, "sub 'water'. Attested in Orkhon Inscriptions (Kültigin E29)."), ("E. V. Sevortjan - ÉSTJa Etimologičeskij Slovar' Tjurkskikh Jazykov Vol. VI (PDF)", 348, "*sub ~ *suv 'voda, reka'.")],
    "göz": [("Andreas Tietze - Tarihi ve Etimolojik Türkiye Türkçesi Sözlüğü Cilt 2 (PDF)", 412, "göz (Eski Türkçe göz / köz kökünden). Görüş organı.")],
    "ayak": [("Sir Gerard Clauson - An Etymological Dictionary of Pre-Thirteenth-Century Turkish (PDF)", 45, "adak 'foot, leg'. Attested in Kültigin E33 (adagın yorıtdı).")],
}
# Notes of three more works on a headword.
NOTES_NAME = "Tietze & Altaica Etimolojik Corpus"
NOTES = {
    "tetik": ("Andreas Tietze (Tarihi ve Etimolojik Türkiye Türkçesi Sözlüğü, TÜBA): tetik 'uyanık, zeki, mekanik horoz düşürücü'. Eski Türkçe tät- 'fark etmek' eyleminden -ik yapım ekiyle.", "Monumenta Altaica / Starostin: Proto-Turkic *tät- / *tetik. Altay, Tuva, Hakas, Kırgız, Özbek, Kazak, Türkmen lehçelerinde canlı.", "Turuz Filoloji Kütüphanesi: tetik (Eski Türkçe tetik / Çağatayca tetik / Özbekçe tetik)."),
    "su": ("Andreas Tietze (TÜBA): su (Eski Türkçe sub / suv). Anadolu ağızlarında ve tüm Türk dünyasında ortak.", "Monumenta Altaica: Proto-Turkic *sub 'water'.", "Turuz Filoloji: sub / suv / suw / шыв / уу / суг."),
    "deniz": ("Andreas Tietze (TÜBA): deniz (Eski Türkçe teŋiz). Orhun ve Uygur metinlerinde teŋiz.", "Monumenta Altaica: Proto-Turkic *teŋiz 'sea'.", "Turuz Filoloji: teŋiz / dəniz / теңіз / деңиз / тиңез / тиңис."),
    "göz": ("Andreas Tietze (TÜBA): göz (Eski Türkçe göz / kör- kökünden). Görüş organı.", "Monumenta Altaica: Proto-Turkic *göŕ 'eye'.", "Turuz Filoloji: göz / köz / kөз / күз / куҫ / көс."),
    "el": ("Andreas Tietze (TÜBA): el (Eski Türkçe elig 'tutma organı' ve el 'halk, yurt, memleket').", "Monumenta Altaica: Proto-Turkic *elig 'hand' & *el 'realm, people'.", "Turuz Filoloji: elig / el / əl / қол / алӑ / ilii."),
    "belge": ("Andreas Tietze (TÜBA): belge 'vesika, delil'. Eski Türkçe belgü 'işaret, alamet' biçiminden. Moğolca belge ile eş kökenli.", "Monumenta Altaica: Proto-Turkic *bẹlgü 'mark, sign'.", "Turuz Filoloji: belgü / belge / белгі / белги / билге / билдә / bəlgə / паллӑ."),
    "bilgi": ("Andreas Tietze (TÜBA): bilgi 'malumat, ilim'. Eski Türkçe biliğ / bil- 'anlamak, bilmek' eyleminden.", "Monumenta Altaica: Proto-Turkic *biliğ / *bil- 'to know'.", "Turuz Filoloji: biliğ / bilgi / білім / билим / bilik."),
    "kut": ("Andreas Tietze (TÜBA): kut 'kutsallık, iyi talih, devlet gücü'. Orhun yazıtlarından beri mevcut.", "Monumenta Altaica: Proto-Turkic *kut 'blessing, soul, fortune'.", "Turuz Filoloji: kut / qut / кот."),
}
