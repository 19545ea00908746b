import random

from conftest import SF
from pyspark.sql import functions as F

from derlem.functions import legal_rules as rules
from derlem.operators import legal
from derlem.operators.legal import extract_metadata
from derlem.queries import _legal_docs

CASES = [
    ("T.C.\nİSTANBUL 3. AİLE MAHKEMESİ\nESAS NO: 2024/780\n\nDAVA DİLEKÇESİ\nDAVACI : Ayşe Kara", "belge.docx",
     {"court_name": "İSTANBUL 3. AİLE MAHKEMESİ", "case_kind": "ESAS", "case_number": "2024/780", "document_type": "Dava Dilekçesi", "plaintiff": "Ayşe Kara"}),
    ("SİGORTA TAHKİM KOMİSYONU BAŞKANLIĞI'NA\nBAŞVURU NO: 2025.E.726196\nDOSYA NO: 2025.E.726196\nBAŞVURAN: Can Demir\nSİGORTA KURULUŞU: Güven Sigorta A.Ş.", "arbitration.pdf",
     {"court_name": "SİGORTA TAHKİM KOMİSYONU", "case_kind": "BASVURU", "case_number": "2025/726196", "plaintiff": "Can Demir", "defendant": "Güven Sigorta A.Ş."}),
    ("T.C.\nANKARA CUMHURİYET BAŞSAVCILIĞI\nSoruşturma No: 2024/45678\nKOVUŞTURMAYA YER OLMADIĞINA DAİR KARAR\nMÜŞTEKİ : Ali Vural\nMÜŞTEKİ VEKİLİ : Av. Bir Kişi\nŞÜPHELİ : Veli Kaya", "savcilik.udf",
     {"court_name": "ANKARA CUMHURİYET BAŞSAVCILIĞI", "case_kind": "SORUSTURMA", "case_number": "2024/45678", "document_type": "Takipsizlik Kararı", "plaintiff": "Ali Vural", "defendant": "Veli Kaya"}),
    ("ANKARA 5. İŞ MAHKEMESİ'NE\nDosya No: 2023/105\nYargıtay 9. Hukuk Dairesi'nin 2019/345 Esas sayılı kararı emsaldir.", "dilekce.docx", {"case_number": "2023/105", "case_kind": "ESAS"}),
    ("DAVACI : 1- Zeynep Aydın (T.C. Kimlik No: 11111111110), adres: İzmir\nDAVALI : Mega Lojistik Taşımacılık San. ve Tic. A.Ş. adres: Ankara", "is_davasi.pdf",
     {"plaintiff": "Zeynep Aydın", "defendant": "Mega Lojistik Taşımacılık San. ve Tic. A.Ş."}),
    ("cevaplarımızı sunarız. Davalı vekili olarak davanın reddi gerekir.", "evrak_123456.udf", {"document_type": "Cevap Dilekçesi"}),
    ("GEREKÇELİ KARAR\nKARAR TARİHİ : 14.05.2024\n", "karar.docx", {"document_type": "Gerekçeli Karar", "document_date": "14.05.2024"}),
    ("", "2024_780_Bilirkişi Raporu_06_05_2024 (1 ek).pdf", {"case_number": "2024/780", "case_kind": "ESAS", "document_type": "Bilirkişi Raporu", "document_date": "06.05.2024"}),
    ("KONU : Kira tespiti hk. ; ek", "x.docx", {"document_type": "Kira tespiti hk."}),
    (None, "serbest ad.txt", {"document_type": "serbest ad", "case_number": None, "court_name": None}),
    ("Yargıtay kararı 2018/12 Esas ile bağlantılı\ndava 2024 / 5 5 esas", "y.txt", {"case_number": "2018/12"}),
]


def test_golden_documents(spark):
    df = spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(CASES)], "id int, body string, filename string")
    rows = {r.id: r.asDict() for r in extract_metadata(df).collect()}
    for i, (_, _, want) in enumerate(CASES):
        assert {k: rows[i][k] for k in want} == want, i


def _one(spark, rows):
    df = spark.createDataFrame([(i, t, "x.txt") for i, t in enumerate(rows)], "id int, body string, filename string")
    return {r.id: r for r in extract_metadata(df).collect()}


def test_every_authority_pattern(spark):
    lines = {
        "2023/45 ANKARA 3. İCRA DAİRESİ - İCRA DOSYASI": "ANKARA 3. İCRA DAİRESİ",
        "İLK DERECE MAHKEMESİ : İZMİR 2. AİLE MAHKEMESİ'NİN kararı": "İZMİR 2. AİLE MAHKEMESİ",
        "BURSA 1. İŞ MAHKEMESİ 2020/11 ESAS DOSYASI": "BURSA 1. İŞ MAHKEMESİ",
        "BURSA İCRA MÜDÜRLÜĞÜ DOSYA NO: 2020/11": "BURSA İCRA MÜDÜRLÜĞÜ",
        "BURSA 4. SULH CEZA HAKİMLİĞİ 2020/11 E.": "BURSA 4. SULH CEZA HAKİMLİĞİ",
        "KONYA 1. ASLİYE CEZA MAHKEMESİ SAYI : 2019/7 esas": "KONYA 1. ASLİYE CEZA MAHKEMESİ",
        "SİGORTA TAHKİM KOMİSYONU BAŞKANLIĞI'NA": "SİGORTA TAHKİM KOMİSYONU",
        "UYUŞMAZLIK HAKEM HEYETİ'NE": "UYUŞMAZLIK HAKEM HEYETİ",
        "ANKARA 5. İŞ MAHKEMESİ'NE": "ANKARA 5. İŞ MAHKEMESİ",
        "ANKARA 5. İŞ MAHK.": "ANKARA 5. İŞ MAHKEMESİ",
        "ANKARA 2. SULH CEZA HAKİMLİĞİ'NE": "ANKARA 2. SULH CEZA HAKİMLİĞİ",
        "ADANA CUMHURİYET BAŞSAVCILIĞI'NA": "ADANA CUMHURİYET BAŞSAVCILIĞI",
        "ADANA 6. İCRA DAİRESİ 01.02.2020": "ADANA 6. İCRA DAİRESİ",
        "MERSİN TAPU MÜDÜRLÜĞÜ'NE": "MERSİN TAPU MÜDÜRLÜĞÜ",
        "TÜRKİYE BAROLAR BİRLİĞİ BAŞKANLIĞI'NA": "TÜRKİYE BAROLAR BİRLİĞİ BAŞKANLIĞI",
        "no authority in this line": None,
    }
    got = _one(spark, [f"T.C.\n{line}\nmetin" for line in lines])
    assert [got[i].court_name for i in range(len(lines))] == list(lines.values())


def test_every_case_label(spark):
    texts = {
        "Esas: 2020/1": ("2020/1", "ESAS"), "dosya : 2020-12": ("2020/12", "ESAS"), "Soruşturma: 2021/3": ("2021/3", "SORUSTURMA"), "Değişik İş: 2021/4": ("2021/4", "DEGISIK_IS"), "Takip: 2021/5": ("2021/5", "TAKIP"),
        "ESAS NO. 2022/6": ("2022/6", "ESAS"), "E. No: 2022/7": ("2022/7", "ESAS"), "Soruşturma Defter No: 2022/8": ("2022/8", "SORUSTURMA"), "Değişik İş No: 2022/9": ("2022/9", "DEGISIK_IS"), "TAKİP NO: 2022/10": ("2022/10", "TAKIP"),
        "Başvuru No: 2023/11": ("2023/11", "BASVURU"), "Dosya No: 2023.E.12": ("2023/12", "BASVURU"), "Başvuru tarihi ve sayısı: 01.02.2023 - 2023.E.13": ("2023/13", "BASVURU"),
        "SAYI : 2023/14 Esas": ("2023/14", "ESAS"), "SAYI : 2023/15 Soruşturma": ("2023/15", "SORUSTURMA"), "SAYI : 2023/16 D. İş": ("2023/16", "DEGISIK_IS"), "SAYI : 2023/17 Takip": ("2023/17", "TAKIP"),
        "konu 2023/18 esas dosyamız": ("2023/18", "ESAS"), "Yargıtay 9. Hukuk Dairesi 2019/345 esas sayılı karar": (None, None), "Esas No: 1979/5": (None, None), "Esas No: 2020/0": (None, None),
        "bkz. Esas No: 2018/1\nEsas No: 2020/2": ("2020/2", "ESAS"), "dosya n o: 2020/1 5": ("2020/15", "ESAS"), "": (None, None),
    }
    got = _one(spark, list(texts))
    assert [(got[i].case_number, got[i].case_kind) for i in range(len(texts))] == list(texts.values())


def test_every_title_names_its_type(spark):
    from derlem.functions.legal_rules import TITLES

    got = _one(spark, [f"metin\n{title.replace('i', 'İ').replace('ı', 'I').upper()} !\nson" for title, _ in TITLES])
    assert [got[i].document_type for i in range(len(TITLES))] == [kind for _, kind in TITLES]


def test_patterns_are_tried_where_their_words_stand(spark):
    """Each label has words that its pattern can't match without, and a text without them isn't searched for it."""
    from derlem.functions import legal_rules as r

    assert len(r.CASE_WORDS) == len(r.CASE_LABELS)
    for words, (_, pattern) in zip(r.CASE_WORDS, r.CASE_LABELS, strict=True):
        assert all(w in pattern for w in words)
    got = _one(spark, ["DOSYA: 2020/1", "E. No: 2022/7", "Başvuru No: 2024 . E . 12", "SAYI: 2021/5 TAKİP", "dava 2019/3 ESAS", "dava 2019/3"])
    assert [(got[i].case_number, got[i].case_kind) for i in range(6)] == [("2020/1", "ESAS"), ("2022/7", "ESAS"), ("2024/12", "BASVURU"), ("2021/5", "TAKIP"), ("2019/3", "ESAS"), (None, None)]


def test_what_is_not_tried_would_not_match(spark, monkeypatch):
    """Lines and texts that are left out by their words, in torn, mixed and odd letters, against trying all of them."""
    r = random.Random(8)
    heads = ["T.C.", "İSTANBUL 3. ASLİYE HUKUK MAHKEMESİ", "BURSA MAHK EMESİNE", "ankara 2. icra d. airesi", "İZMİR İCRA D.A İRESİ", "X BAŞ\x01SAVCILIĞI", "VAN BAŞſAVCILIĞI", "İL HAKKİMLİĞİ", "RİZE HÂKİMLİĞİ'NE", "SİGORTA TAHKİM KOMİSYONU", "İTİRAZ HAKEM HEYETİ", "1. MAHKEMESİ 2020 / 12 ESAS", "VALİ MÜDÜRLÜĞÜ", "UYGULAMA : X MAHKEMESİNİN", "KURUM BAŞKANLIĞINA"]
    titles = ["DAVA DİLEKÇESİDİR", "**Gerekçeli   Karar**", "kyok", "Yargıtay İlamıdır", "TENSİP\tTUTANAĞI", "dava dilekçesi hakkında", "KARAR-İLAMI\r", "Vekaletname."]
    labels = ["DAVACI", "Davacı ve Davalı", "MÜŞTEKİ", "karşı taraf", "DAVACI VEKİLİ", "SANIK", "KONU", "Şikâyetçi"]
    values = ["Ali Veli", "1) Bir (TCKN: 12)", "A, adres: yok", "B - 1234567 x", "C —", "D vergi no 3", "E, 1980 doğumlu", "  F   G ", "x", ""]
    cases = ["ESAS NO : 2020/12", "dosya no 2021/5", "E. NO: 2019/7", "e\nno 2018/ 3", "SAYI : 2020/9 ESAS", "2017/4 esas", "BAŞVURU NO 2016/8 ve ESAS NO 2015/1", "😀 TAKİP NO: 2014/6"]
    bodies = ["cevaplarımız ve davalı vekilı davanın reddi", "gereği düşünüldü\n hüküm :", "karar no : 1\nHÜKÜM", "rapora itiraz, kabul etmiyoruz, ek  rapor", "saygılarımla", "savunmalarımız; husumet yokluğu"]
    parts = [heads, titles, [f"{a} : {b}" for a in labels for b in values], cases, bodies, ["tarih 01.02.2020", "", "\x0b", "a\tb"]]
    rows = [(i, "\n".join(r.choice(r.choice(parts)) for _ in range(r.randint(0, 12))), "2020_1_Rapor.docx") for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, body string, filename string").repartition(4)
    seen = lambda: {x.id: tuple(x) for x in legal.extract_metadata(df).select("id", *legal.FIELDS).collect()}
    found, all_ = seen(), ("",)
    for name, value in (("AUTHORITY_PARTS", all_), ("AUTHORITY_NEEDS", (all_,) * len(rules.AUTHORITIES)), ("TITLE_PARTS", all_), ("STRUCTURE_WORDS", ((all_,) * 3,) * 3), ("CASE_NEEDS", {}), ("PARTY_CUT_SIGNS", "")):
        monkeypatch.setattr(rules, name, value)
    assert found == seen() and all(len({x[k] for x in found.values()}) > 1 for k in range(1, 8))


def test_orders_are_dealt_to_all_tasks(spark, tmp_path):
    """From one file, and with ten suppliers: no task makes the texts of a tenth of the orders."""
    for name in ("orders", "customer", "supplier"):
        spark.read.parquet(f"{SF}/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = _legal_docs(spark, str(tmp_path))
    n = [r["count"] for r in docs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(n) == spark.read.parquet(f"{SF}/orders.parquet").count() and max(n) < sum(n) / 8
