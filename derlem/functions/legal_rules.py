"""Fixed values of the legal metadata extractor: patterns, titles and roles that must be these for right results.

Patterns are in Java's dialect. (?iu) also equates the dotted and dotless i, a little more than the source texts need."""

#: What names an authority, tried in this order on each header line; group 1 is the authority.
AUTHORITIES = (
    r"(?iu)^\D?\s*\d{4}\s*\/\s*\d{1,7}\s+(.{3,100}?İCRA\s+DA[İIıi]RES[İIıi])\s*[-–—]\s*İCRA\s+DOSYAS[İIıi].*$",
    r"(?iu)^(?:UYGULAMA|İLK\s+DERECE\s+MAHKEMESİ)\s*:\s*(.{3,100}?MAHKEMES[İI])['’]?\s*N[İI]N\b.*$",
    r"(?iu)^(.{3,100}?(?:MAHKEMESİ|BAŞSAVCILIĞI|İCRA\s+DAİRESİ))\s+\d{4}\s*\/\s*\d(?:\s*\d){0,6}\s+(?:ESAS|SORUŞTURMA|DEĞİŞİK\s+İŞ)?\s*DOSYASI\s*$",
    r"(?iu)^(.{3,100}?(?:MAHKEMESİ|BAŞSAVCILIĞI|İCRA\s+DAİRESİ|İCRA\s+MÜDÜRLÜĞÜ))\s*[-–—]?\s*(?:ESAS|DOSYA|SORUŞTURMA|DEĞİŞİK\s+İŞ|TAKİP|BAŞVURU)\s*(?:NO\.?)?\s*[:][ \t]*\d{4}\s*\/\s*\d(?:\s*\d){0,6}\s*$",
    r"(?iu)^(.{3,100}?(?:MAHKEMES(?:İ|I)|BAŞSAVCILIĞ(?:I|İ)|İCRA\s+DA[İI]RES(?:İ|I)|İCRA\s+M[ÜU]D[ÜU]RL[ÜU]Ğ[ÜU]|H[AÂ]K[İI]ML[İI]Ğ(?:İ|I)))\s*[-–—]?\s*\d{4}\s*\/\s*\d(?:\s*\d){0,6}(?:\s+(?:ESAS|E\.))?\s*$",
    r"(?iu)^(.{3,80}?(?:MAHKEMES[İIi]|H[AÂ]K[İIıi]ML[İIıi]Ğ[İIıi]|BA(?:Ş|S)SAVC[Iı]L[Iı]Ğ[İIıi]))\s+SAY[Iı]\s*:\s*\d{4}\s*[\/-]\s*\d",
    r"(?iu)^((?:.{0,40}?\s)?(?:S[İIıi]GORTA\s+)?TAHK[İIıi]M\s+KOM[İIıi]SYONU)(?:['’]?\s*N[AEae])?(?:\s+BAŞKANLIĞI)?",
    r"(?iu)^((?:UYU[ŞS]MAZLIK|[İIıi]T[İIıi]RAZ)\s+HAKEM\s+HEYET[İIıi])(?:['’]?\s*N[AEae])?",
    r"(?iu)^(.{3,100}?MAHKEMES(?:İ|I)(?:['’]?\s*(?:NE|NA))?)\s*$",
    r"(?iu)^(.{3,100}?\bMAHK\.)\s*$",
    r"(?iu)^(.{3,100}?H[AÂ]K[İI]ML[İI]Ğ(?:İ|I)(?:['’]?\s*(?:NE|NA))?)\s*$",
    r"(?iu)^(.{3,100}?BA(?:Ş|S)SAVCILIĞ(?:I|İ)(?:['’]?\s*(?:NA|NE))?)\s*$",
    r"(?iu)^(.{3,100}?DA[İI]RES(?:İ|I)(?:['’]?\s*(?:NE|NA))?)(?:\s+(?:ÖRNEK\s+NO\b.*|\d{2}[./-]\d{2}[./-]\d{4}.*))?\s*$",
    r"(?iu)^(.{3,100}?M[ÜU]D[ÜU]RL[ÜU]Ğ[ÜU](?:'?(?:NE|NA))?)\s*$",
    r"(?iu)^(.{3,100}?BA(?:Ş|S)KANLIĞ(?:I|İ)(?:'?(?:NA|NE))?)\s*$",
)
#: What a line in lower case has, if the pattern at the same place matches; no letters that have an unusual lower or upper case.
AUTHORITY_NEEDS = (("/",), (":",), ("/",), ("/",), ("/",), (":",), ("kom",), ("hakem",), ("mahkeme",), ("mahk.",), ("hak", "hâk"), ("avc",), ("re",), ("rl",), ("kanl",))
#: Every authority has one of these stems, so lines without any needn't be tried.
AUTHORITY_STEMS = r"(?iu)MAHK|SAVC|DA[İI]RES|D[ÜU]RL|H[AÂ]K|KANL"
#: Parts of the stems in lower case; lines that have none, nor a control character that goes when they are cleaned, can't come to have a stem. A long s
#: counts as an s there.
AUTHORITY_PARTS = ("mahk", "savc", "res", "rl", "hak", "hâk", "kanl", "ſ")

_SEQ = r"(\d(?:[ \t]*\d){0,6})"
_YEAR_SEQ = rf"[ \t]*(\d{{4}})[ \t]*[/-][ \t]*{_SEQ}"

#: (kind, pattern over lower-cased text with year and sequence in groups 1 and 2).
CASE_LABELS = (
    ("ESAS", rf"(?m)^[ \t]*(?:esas|dosya)[ \t]*:{_YEAR_SEQ}"),
    ("SORUSTURMA", rf"(?m)^[ \t]*soruşturma[ \t]*:{_YEAR_SEQ}"),
    ("DEGISIK_IS", rf"(?m)^[ \t]*değişik[ \t]*iş[ \t]*:{_YEAR_SEQ}"),
    ("TAKIP", rf"(?m)^[ \t]*takip[ \t]*:{_YEAR_SEQ}"),
    ("ESAS", rf"(?:(?:esas|dosya)\s*no\.?|(?<![a-zçğıiöşü])e\.?\s*no\.?)\s*[:.\-]?\s*(\d{{4}})[ \t]*[/-][ \t]*{_SEQ}"),
    ("SORUSTURMA", rf"soruşturma(?:[ \t]+defter)?[ \t]*no\.?[ \t]*[:.\-]?{_YEAR_SEQ}"),
    ("DEGISIK_IS", rf"değişik[ \t]*iş[ \t]*no\.?[ \t]*[:.\-]?{_YEAR_SEQ}"),
    ("TAKIP", rf"takip[ \t]*no\.?[ \t]*[:.\-]?{_YEAR_SEQ}"),
    ("BASVURU", rf"başvuru[ \t]*no\.?[ \t]*[:.\-]?{_YEAR_SEQ}"),
    ("BASVURU", rf"(?:dosya|başvuru)[ \t]*no\.?[ \t]*[:.\-]?[ \t]*(\d{{4}})[ \t]*[./ ][ \t]*e[ \t]*\.?[ \t]*{_SEQ}"),
    ("BASVURU", r"başvuru[ \t\r\n]+tarihi[ \t\r\n]+ve[ \t\r\n]+sayısı[ \t\r\n]*:?[ \t\r\n]*(?:\d{2}[./]\d{2}[./]\d{4}[ \t]*[-–][ \t]*)?(\d{4})[ \t]*\.?[ \t]*e\.?[ \t]*(\d{1,7})"),
)
#: Words of which a text that matches the label's pattern has one, in the same order; texts without any needn't be tried.
CASE_WORDS = (("esas", "dosya"), ("soruşturma",), ("değişik",), ("takip",), ("no",), ("soruşturma",), ("değişik",), ("takip",), ("başvuru",), ("dosya", "başvuru"), ("başvuru",))

#: By the label's place: words and a pattern that is quicker to try; a text that matches the label's pattern has a word or matches it.
CASE_NEEDS = {4: (("esas", "dosya"), r"e\.?\s*no")}

#: The same for the header's number line, looked for in the first 3000 characters.
CASE_HEADERS = (
    ("ESAS", rf"sayı[ \t]*:{_YEAR_SEQ}[ \t]+(?:esas|e\.)(?![a-zçğıöşü])"),
    ("SORUSTURMA", rf"sayı[ \t]*:{_YEAR_SEQ}[ \t]+soruşturma(?![a-zçğıöşü0-9])"),
    ("DEGISIK_IS", rf"sayı[ \t]*:{_YEAR_SEQ}[ \t]+(?:değişik[ \t]+iş|d\.[ \t]*iş)(?![a-zçğıöşü0-9])"),
    ("TAKIP", rf"sayı[ \t]*:{_YEAR_SEQ}[ \t]+takip(?![a-zçğıöşü0-9])"),
)
CASE_BARE = rf"(\d{{4}})[ \t]*/[ \t]*{_SEQ}[ \t]+esas(?![a-zçğıöşü])"
CITATION_TAIL = r"^\s*,?\s*sayılı\s+(karar|ilam|içtihat|dosya|dava|duruşma)"
AUTHORITY_BEFORE = r"(mahkeme|hakimliğ|hâkimliğ|başsavcılığ|savcılığ|daire|müdürlüğ|komisyon|heyet)"

#: (title, the type that it names).
TITLES = (
    ("Dava Dilekçesi", "Dava Dilekçesi"),
    ("Cevap Dilekçesi", "Cevap Dilekçesi"),
    ("İkinci Cevap Dilekçesi", "İkinci Cevap Dilekçesi"),
    ("Cevaba Cevap Dilekçesi", "Cevaba Cevap Dilekçesi"),
    ("Beyan Dilekçesi", "Beyan Dilekçesi"),
    ("Karşı Dava Dilekçesi", "Karşı Dava Dilekçesi"),
    ("Islah Dilekçesi", "Islah Dilekçesi"),
    ("Değişik İş Başvuru Dilekçesi", "Değişik İş Başvuru Dilekçesi"),
    ("Tutukluluk Halinin Devamı Kararına İtiraz Dilekçesi", "Tutukluluk Halinin Devamı Kararına İtiraz Dilekçesi"),
    ("Borca İtiraz Talebi", "Borca İtiraz"),
    ("İtiraz Dilekçesi", "İtiraz Dilekçesi"),
    ("İstinaf Başvuru Dilekçesi", "İstinaf Başvuru Dilekçesi"),
    ("İstinaf Dilekçesi", "İstinaf Başvuru Dilekçesi"),
    ("İstinafa Cevap Dilekçesi", "İstinafa Cevap Dilekçesi"),
    ("Temyiz Başvuru Dilekçesi", "Temyiz Başvuru Dilekçesi"),
    ("Temyiz Dilekçesi", "Temyiz Başvuru Dilekçesi"),
    ("Temyize Cevap Dilekçesi", "Temyize Cevap Dilekçesi"),
    ("Gerekçeli Karar Evrakı", "Gerekçeli Karar"),
    ("Gerekçeli Karar", "Gerekçeli Karar"),
    ("Karar İlamı", "Gerekçeli Karar"),
    ("Gerekçeli Karar İlamı", "Gerekçeli Karar"),
    ("Ara Karar Evrakı", "Ara Karar"),
    ("Ara Karar", "Ara Karar"),
    ("İstinaf İlamı", "İstinaf İlamı"),
    ("BAM İlamı", "İstinaf İlamı"),
    ("Temyiz İlamı", "Temyiz İlamı"),
    ("Yargıtay İlamı", "Temyiz İlamı"),
    ("Rapor", "Bilirkişi Raporu"),
    ("Bilirkişi Raporu", "Bilirkişi Raporu"),
    ("Bilirkişi Raporuna İtiraz Dilekçesi", "Bilirkişi Raporuna İtiraz Dilekçesi"),
    ("Bilirkişi Raporuna Karşı Beyan Dilekçesi", "Bilirkişi Raporuna Karşı Beyan Dilekçesi"),
    ("Duruşma Tutanağı", "Duruşma Tutanağı"),
    ("Duruşma Zaptı", "Duruşma Tutanağı"),
    ("Tensip Zaptı", "Tensip Zaptı"),
    ("Tensip Tutanağı", "Tensip Zaptı"),
    ("İfade Tutanağı", "İfade Tutanağı"),
    ("Şikayetçi İfade Tutanağı", "İfade Tutanağı"),
    ("Emanet Eşya Makbuzu", "Emanet Eşya Makbuzu"),
    ("Tebliğ Mazbatası", "Tebligat Parçası"),
    ("Tebligat Mazbatası", "Tebligat Parçası"),
    ("Tebligat", "Tebligat Parçası"),
    ("Müzekkere", "Müzekkere"),
    ("Müzekkere Cevabı", "Müzekkere Cevabı"),
    ("Harç Makbuzu", "Harç Makbuzu"),
    ("Gider Avansı Makbuzu", "Gider Avansı Makbuzu"),
    ("Eksper Raporu", "Eksper Raporu"),
    ("Trafik Kazası Tespit Tutanağı", "Trafik Kazası Tespit Tutanağı"),
    ("Kaza Tespit Tutanağı", "Trafik Kazası Tespit Tutanağı"),
    ("Vekaletname", "Vekaletname"),
    ("Mirasçılık Belgesi", "Mirasçılık Belgesi"),
    ("Takipsizlik Kararı", "Takipsizlik Kararı"),
    ("Takipsizlik", "Takipsizlik Kararı"),
    ("KYOK", "Takipsizlik Kararı"),
    ("Kovuşturmaya Yer Olmadığına Dair Karar", "Takipsizlik Kararı"),
    ("Kovuşturmaya Yer Olmadığı Kararı", "Takipsizlik Kararı"),
    ("Değişik İş Kararı", "Değişik İş Kararı"),
)

#: Each title has one of these, in lower case.
TITLE_PARTS = ("dilekçe", "itiraz", "karar", "ilam", "rapor", "tutana", "zapt", "makbuz", "mazbata", "tebligat", "müzekkere", "vekaletname", "mirasçılık", "takipsizlik", "kyok")

#: (type, three families of which two must be there, guards of which none may): over lower-cased text.
STRUCTURES = (
    ("Cevap Dilekçesi",
     (r"(?:cevap\s+dilekçe|cevaplar[ıi]m[ıi]z|savunmalar[ıi]m[ıi]z)", r"(?:daval[ıi]\s+vekil[ıi]|cevap\s+veren|müvekkil(?:im)?\s+daval[ıi])",
      r"(?:davan[ıi]n\s+(?:esastan\s+)?reddi|haks[ıi]z\s+ve\s+mesnetsiz|husumet\s+yoklu[ğg]u|zamana[şs][ıi]m[ıi]\s+itiraz)"),
     (r"(?:gere[ğg]i\s+d[üu][şs][üu]n[üu]ld[üu]|^\s*h[üu]k[üu]m\s*:|dava\s+dilekçesidir)",)),
    ("Gerekçeli Karar",
     (r"(?:gere[ğg]i\s+d[üu][şs][üu]n[üu]ld[üu]|karar\s+ver[iı]lm[iı][şs]t[iı]r)", r"(?m)(?:^\s*h[üu]k[üu]m\s*:?|^\s*hükümler\s*:)",
      r"(?:karar\s*(?:no|numaras[ıi])\s*[:\-]|esas\s*no\s*[:\-].*karar\s*no\s*[:\-])"),
     (r"\barz\s+(?:ve\s+talep\s+)?eder(?:im|iz)\b|\btalep\s+eder(?:im|iz)\b|\bsayg[ıi]lar[ıi]mla\b", r"emsal\s+karar", r"say[ıi]l[ıi]\s+karar[ıi]nda")),
    ("Bilirkişi Raporuna İtiraz Dilekçesi",
     (r"(?:bilirki[şs]i\s+raporuna\s+(?:kar[şs][ıi]\s+)?itiraz|rapora\s+itiraz)", r"(?:itirazlar[ıi]m[ıi]z|beyanlar[ıi]m[ıi]z|kabul\s+etmiyoruz)",
      r"(?:ek\s+rapor|yeni(?:den)?\s+bilirki[şs]i|ba[şs]ka\s+bir\s+bilirki[şs]i\s+heyeti)"),
     (r"(?:gere[ğg]i\s+d[üu][şs][üu]n[üu]ld[üu]|^\s*h[üu]k[üu]m\s*:)",)),
)

#: For each type and family words of which a text that matches the family has one; texts without any needn't be tried.
STRUCTURE_WORDS = (
    (("cevap", "savunmalar"), ("vekil", "cevap", "müvekkil"), ("davan", "haks", "husumet", "zamana")),
    (("gere", "karar"), ("hüküm", "hükum", "huküm", "hukum"), ("karar",)),
    (("bilirki", "rapora"), ("itirazlar", "beyanlar", "kabul"), ("rapor", "bilirki")),
)

SUBJECT = r"(?iu)(?:KONU|TALEP\s*KONUSU|DAVA\s*TÜRÜ)\s*[:/]\s*([^\n;]+)"
#: Words near which a type's date stands, before the general ones.
DATE_WORDS = (
    ("Duruşma Tutanağı", ("duruşma tarihi", "celse tarihi", "duruşma günü")),
    ("Gerekçeli Karar", ("karar tarihi", "karar tarih")),
    ("Bilirkişi Raporu", ("rapor tarihi",)),
    ("Tebligat", ("tebliğ tarihi", "tebellüğ tarihi")),
)
GENERAL_DATE_WORDS = ("tarih", "karar tarihi", "duruşma tarihi")
DATE = r"\b(\d{1,2})[./\-](\d{1,2})[./\-](\d{4})\b"

PLAINTIFF_ROLES = ("DAVACI", "MÜŞTEKİ", "ŞİKAYETÇİ", "ŞİKÂYETÇİ", "KATILAN", "BAŞVURU SAHİBİ", "BAŞVURAN", "ALACAKLI", "TALEP EDEN")
DEFENDANT_ROLES = ("DAVALI", "ŞÜPHELİ", "SANIK", "BORÇLU", "SİGORTA KURULUŞU", "KARŞI TARAF")
#: What is cut from a party's value, in this order.
PARTY_CUTS = (
    (r"(?i)\([^)]*(?:tckn|vkn|tc\s*kimlik|vergi|sicil|adres|no)[^)]*\)", " "),
    (r"\s+[-–—]\s+\d{6,}\s*[-–—]?.*$", ""),
    (r"(?i),\s*(?:t\.?c\.?\s*kimlik|tckn|vkn|vergi)\s*(?:/\s*yupass)?\s*(?:no)?\s*[:.]?.*$", ""),
    (r"(?i)\s+(?:t\.?c\.?\s*kimlik|tckn|vkn|vergi)\s*(?:/\s*yupass)?\s*(?:no)?\s*[:.]?.*$", ""),
    (r"(?i),\s*adres\s*[:.]?.*$", ""),
    (r"(?i)\s+adres\s*[:.]?.*$", ""),
    (r"(?iu),.*\b(?:kızı|oğlu|doğumlu|t\.?c\.?\s*kimlik)\b.*$", ""),
    (r"\s+[-–—|]+\s*$", ""),
    (r"^\s*\d+[.)-]\s*", ""),
    (r"(?U)\s+", " "),
)
#: A value without any of these is left as it is by all cuts but the last.
PARTY_CUT_SIGNS = r"(?iu)[(,|–—-]|^\s*\d|kimlik|tckn|vkn|vergi|adres"
FILENAME = r"(?i)^(\d{4})[_\s](\d{1,7})[_\s](.+?)(?:[_\s](\d{2})[_\s](\d{2})[_\s](\d{4}))?(?:[_\s]\((\d+)[_\s]?ek\))?$"
