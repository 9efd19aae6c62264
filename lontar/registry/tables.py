"""Locales, countries and what hangs on them. Fixed values throughout this module."""

from __future__ import annotations

DIGITS = {
    "th": "๐๑๒๓๔๕๖๗๘๙",
    "lo": "໐໑໒໓໔໕໖໗໘໙",
    "km": "០១២៣៤៥៦៧៨៩",
    "my": "၀၁၂၃၄၅၆၇၈၉",
    "shn": "႐႑႒႓႔႕႖႗႘႙",
    "jv-Java": "꧐꧑꧒꧓꧔꧕꧖꧗꧘꧙",
}

#: First of ten digits of each numbering that is read as ASCII digits.
DIGIT_ZEROS = (0x0E50, 0x0ED0, 0x17E0, 0x1040, 0x1090, 0xA9D0, 0x0BE6, 0x0660, 0xFF10)

# code | English name | own name | script | CLDR locale | currency | count order | fallback after itself | countries
LOCALES = """
en | English | English | Latn | en | USD | num-noun | | SG MY PH BN PG
vi | Vietnamese | Tiếng Việt | Latn | vi-VN | VND | num-clf-noun | en | VN
th | Thai | ไทย | Thai | th-TH | THB | noun-num-clf | en | TH
id | Indonesian | Bahasa Indonesia | Latn | id-ID | IDR | num-clf-noun | en | ID
jv | Javanese | Basa Jawa | Latn | jv-ID | IDR | num-clf-noun | id en | ID
jv-Java | Javanese (Javanese script) | ꦧꦱꦗꦮ | Java | jv-ID | IDR | num-clf-noun | jv id en | ID
su | Sundanese | Basa Sunda | Latn | su-ID | IDR | num-clf-noun | id en | ID
ms | Malay | Bahasa Melayu | Latn | ms-MY | MYR | num-clf-noun | en | MY BN SG
ms-Arab | Malay (Jawi script) | بهاس ملايو | Arab | ms-Arab-MY | MYR | num-clf-noun | ms en | MY BN
ms-BN | Malay (Brunei) | Bahasa Melayu Brunei | Latn | ms-BN | BND | num-clf-noun | ms en | BN
ms-Arab-BN | Malay (Brunei, Jawi script) | بهاس ملايو بروني | Arab | ms-Arab-BN | BND | num-clf-noun | ms-Arab ms-BN ms en | BN
fil | Filipino | Filipino | Latn | fil-PH | PHP | num-noun | en | PH
ceb | Cebuano | Binisaya | Latn | ceb-PH | PHP | num-noun | fil en | PH
my | Burmese | မြန်မာ | Mymr | my-MM | MMK | noun-num-clf | en | MM
shn | Shan | ၵႂၢမ်းတႆး | Mymr | shn-MM | MMK | noun-num-clf | my en | MM
km | Khmer | ភាសាខ្មែរ | Khmr | km-KH | KHR | noun-num-clf | en | KH
lo | Lao | ພາສາລາວ | Laoo | lo-LA | LAK | noun-num-clf | th en | LA
tet | Tetum | Tetun | Latn | pt-TL | USD | num-noun | pt-TL en | TL
pt-TL | Portuguese (Timor-Leste) | Português | Latn | pt-TL | USD | num-noun | en | TL
en-SG | English (Singapore) | English | Latn | en-SG | SGD | num-noun | en | SG
zh-Hans-SG | Chinese (Simplified, Singapore) | 华语 | Hans | zh-Hans-SG | SGD | num-clf-noun | en-SG en | SG
ta-SG | Tamil (Singapore) | தமிழ் | Taml | ta-SG | SGD | num-noun | en-SG en | SG
ms-SG | Malay (Singapore) | Bahasa Melayu | Latn | ms-SG | SGD | num-clf-noun | ms en-SG en | SG
tpi | Tok Pisin | Tok Pisin | Latn | en-PG | PGK | num-noun | en-PG en | PG
en-PG | English (Papua New Guinea) | English | Latn | en-PG | PGK | num-noun | en | PG
fil-x-taglish | Taglish | Taglish | Latn | fil-PH | PHP | num-noun | fil en | PH
en-SG-x-singlish | Singlish | Singlish | Latn | en-SG | SGD | num-noun | en-SG en | SG
id-x-gaul | Bahasa gaul | Bahasa gaul | Latn | id-ID | IDR | num-clf-noun | id en | ID
ms-x-manglish | Manglish | Manglish | Latn | ms-MY | MYR | num-clf-noun | ms en | MY
"""

# code | name | own name | currency | symbol | decimals | calling | time zones | locales, the default first | first day | name order | mononyms common
COUNTRIES = """
BN | Brunei | Negara Brunei Darussalam | BND | B$ | 2 | +673 | Asia/Brunei | ms-BN ms-Arab-BN en | 0 | patronymic | no
KH | Cambodia | កម្ពុជា | KHR | ៛ | 0 | +855 | Asia/Phnom_Penh | km en | 0 | family-given | no
ID | Indonesia | Indonesia | IDR | Rp | 0 | +62 | Asia/Jakarta Asia/Makassar Asia/Jayapura | id jv jv-Java su id-x-gaul en | 0 | given-family | yes
LA | Laos | ລາວ | LAK | ₭ | 0 | +856 | Asia/Vientiane | lo en | 0 | given-family | no
MY | Malaysia | Malaysia | MYR | RM | 2 | +60 | Asia/Kuala_Lumpur | ms ms-Arab ms-x-manglish en zh-Hans-SG ta-SG | 1 | patronymic | no
MM | Myanmar | မြန်မာ | MMK | K | 0 | +95 | Asia/Yangon | my shn en | 0 | mononym | yes
PH | Philippines | Pilipinas | PHP | ₱ | 2 | +63 | Asia/Manila | fil ceb fil-x-taglish en | 0 | given-family | no
SG | Singapore | Singapore | SGD | S$ | 2 | +65 | Asia/Singapore | en-SG zh-Hans-SG ms-SG ta-SG en-SG-x-singlish | 1 | given-family | no
TH | Thailand | ประเทศไทย | THB | ฿ | 2 | +66 | Asia/Bangkok | th en | 0 | given-family | no
TL | Timor-Leste | Timór-Leste | USD | $ | 2 | +670 | Asia/Dili | tet pt-TL id en | 1 | given-family | no
VN | Vietnam | Việt Nam | VND | ₫ | 0 | +84 | Asia/Ho_Chi_Minh | vi en | 1 | family-given | no
PG | Papua New Guinea | Papua Niugini | PGK | K | 2 | +675 | Pacific/Port_Moresby Pacific/Bougainville | tpi en-PG en | 1 | given-family | no
"""

UNSPACED = ("th", "my", "shn", "km", "lo", "zh-Hans-SG")
CODE_MIXED = {"fil-x-taglish": "fil", "en-SG-x-singlish": "en-SG", "id-x-gaul": "id", "ms-x-manglish": "ms"}
REGISTERS = ("formal", "neutral", "casual")
MIXED_REGISTERS = ("neutral", "casual")
BUDDHIST = ("th",)
WHOLE_CURRENCIES = ("VND", "IDR", "KHR", "LAK", "MMK")

# locale: person animal thing book vehicle flat long round building plant pair cloth
CATEGORIES = ("person", "animal", "thing", "book", "vehicle", "flat", "long", "round", "building", "plant", "pair", "cloth")
CLASSIFIERS = """
vi: người con cái quyển chiếc tờ cây quả ngôi cây đôi tấm
th: คน ตัว อัน เล่ม คัน แผ่น แท่ง ลูก หลัง ต้น คู่ ผืน
km: នាក់ ក្បាល ដុំ ក្បាល គ្រឿង សន្លឹក ដើម គ្រាប់ ខ្នង ដើម គូ ផ្ទាំង
lo: ຄົນ ໂຕ ອັນ ຫົວ ຄັນ ແຜ່ນ ທ່ອນ ໜ່ວຍ ຫຼັງ ຕົ້ນ ຄູ່ ຜືນ
my: ယောက် ကောင် ခု အုပ် စီး ရွက် ချောင်း လုံး ဆောင် ပင် စုံ ထည်
id: orang ekor buah buah buah lembar batang butir buah batang pasang helai
ms: orang ekor buah buah buah helai batang biji buah batang pasang helai
zh-Hans-SG: 位 只 个 本 辆 张 条 颗 座 棵 双 块
"""

# locale | male statement, question | female statement, question | neutral statement, question
PARTICLES = """
th | ครับ ครับ | ค่ะ คะ |
my | ခင်ဗျာ ခင်ဗျာ | ရှင် ရှင် | ပါ ပါ
km | បាទ បាទ | ចាស ចាស |
vi | ạ ạ | ạ ạ | ạ ạ
fil | po po | po po | po po
lo | ເດີ້ ເດີ້ | ເດີ້ ເດີ້ | ເດີ້ ເດີ້
"""

# locale | formal you, I, we | neutral you, I, we | casual you, I, we; male/female where they differ
PRONOUNS = """
vi | quý khách, tôi, chúng tôi | bạn, tôi, chúng tôi | cậu, mình, bọn mình
th | ท่าน, ข้าพเจ้า, เรา | คุณ, ผม/ดิฉัน, เรา | เธอ, ฉัน, เรา
km | លោក, ខ្ញុំបាទ, យើងខ្ញុំ | អ្នក, ខ្ញុំ, យើង | អ្នក, ខ្ញុំ, យើង
lo | ທ່ານ, ຂ້າພະເຈົ້າ, ພວກເຮົາ | ເຈົ້າ, ຂ້ອຍ, ພວກເຮົາ | ເຈົ້າ, ຂ້ອຍ, ເຮົາ
my | ခင်ဗျား/ရှင်, ကျွန်တော်/ကျွန်မ, ကျွန်တော်တို့ | ခင်ဗျား/ရှင်, ကျွန်တော်/ကျွန်မ, ကျွန်တော်တို့ | မင်း, ငါ, ငါတို့
id | Anda, saya, kami | kamu, saya, kami | lo, gue, kita
ms | anda, saya, kami | awak, saya, kami | kau, aku, kita
jv | panjenengan, kula, kula sedaya | sampeyan, kula, kita | kowé, aku, awaké dhéwé
su | anjeun, abdi, abdi sadaya | anjeun, abdi, urang | manéh, urang, urang
fil | kayo, ako, kami | ikaw, ako, kami | ikaw, ako, tayo
ceb | kamo, ako, kami | ikaw, ako, kami | ikaw, ako, kita
tet | Ita-boot, ha'u, ami | Ita, ha'u, ami | o, ha'u, ita
tpi | yu, mi, mipela | yu, mi, mipela | yu, mi, yumi
zh-Hans-SG | 您, 我, 我们 | 你, 我, 我们 | 你, 我, 我们
ta-SG | தாங்கள், நான், நாங்கள் | நீங்கள், நான், நாங்கள் | நீ, நான், நாம்
en | you, I, we | you, I, we | you, I, we
"""

# locale | formal | neutral | casual
SPEECH_LEVELS = """
jv | krama | madya | ngoko
su | lemes | sedeng | loma
th | ราชาศัพท์/สุภาพ | สุภาพ | กันเอง
km | ភាសាសុភាព | ធម្មតា | មិត្តភាព
"""

# script or locale | family | web font | weights | line height
FONTS = """
Latn | "Inter", system-ui, -apple-system, sans-serif | Inter | 400 500 700 | 1.5
vi | "Be Vietnam Pro", "Inter", system-ui, sans-serif | Be Vietnam Pro | 400 500 700 | 1.6
Thai | "Noto Sans Thai", "Sarabun", sans-serif | Noto Sans Thai | 400 500 700 | 1.75
Laoo | "Noto Sans Lao", "Phetsarath OT", sans-serif | Noto Sans Lao | 400 500 700 | 1.75
Khmr | "Noto Sans Khmer", "Khmer OS Battambang", sans-serif | Noto Sans Khmer | 400 500 700 | 1.95
Mymr | "Noto Sans Myanmar", "Padauk", sans-serif | Noto Sans Myanmar | 400 500 700 | 1.95
Java | "Noto Sans Javanese", sans-serif | Noto Sans Javanese | 400 700 | 1.9
Hans | "Noto Sans SC", "PingFang SC", sans-serif | Noto Sans SC | 400 500 700 | 1.7
Taml | "Noto Sans Tamil", sans-serif | Noto Sans Tamil | 400 500 700 | 1.75
Arab | "Noto Naskh Arabic", "Scheherazade New", serif | Noto Naskh Arabic | 400 700 | 1.85
"""

# order of name parts | key, label, required ...
NAME_FIELDS = {
    "mononym": (("full", "Name", True),),
    "patronymic": (("given", "Name", True), ("patronymic", "bin / binti", False), ("family", "Father's name", False)),
    "family-given": (("family", "Family name", True), ("middle", "Middle name", False), ("given", "Given name", True)),
    "given-family": (("given", "Given name", True), ("middle", "Middle name", False), ("family", "Family name", True)),
}

#: Jawi letters and how each is written in Latin letters.
JAWI_TO_RUMI = (
    ("ا", "a"), ("ب", "b"), ("ت", "t"), ("ث", "th"), ("ج", "j"), ("چ", "c"), ("ح", "h"), ("خ", "kh"), ("د", "d"), ("ذ", "dz"),
    ("ر", "r"), ("ز", "z"), ("س", "s"), ("ش", "sy"), ("ص", "s"), ("ض", "d"), ("ط", "t"), ("ظ", "z"), ("ع", "'"), ("غ", "gh"),
    ("ڠ", "ng"), ("ف", "f"), ("ڤ", "p"), ("ق", "q"), ("ک", "k"), ("ݢ", "g"), ("ل", "l"), ("م", "m"), ("ن", "n"), ("و", "w"),
    ("ۏ", "v"), ("ه", "h"), ("ة", "t"), ("ء", "'"), ("ي", "y"), ("ڽ", "ny"), ("ى", "a"),
)
RUMI_DIGRAPHS = (("ng", "ڠ"), ("ny", "ڽ"), ("sy", "ش"), ("kh", "خ"), ("gh", "غ"), ("th", "ث"), ("dz", "ذ"), ("ch", "چ"))
RUMI_LETTERS, JAWI_LETTERS = "abcdefghijklmnopqrstuvwyz", "ابچديفݢهيجکلمنوڤقرستوۏويز"
