"""Rule tables. They are data: every function that reads one takes another in its place."""

# Category names and the substrings that decide them, in order.
CATEGORY_ENUM = ("лаборатория", "приём врача", "диагностика", "процедура")
CATEGORY_RULES = (
    (("прием", "приём", "консультац", "врач", "терапевт", "кардиолог", "невролог", "гинеколог", "уролог", "эндокринолог", "офтальмолог", "дерматолог", "лор"), "приём врача"),
    (("узи", "мрт", "кт ", "рентген", "ренген", "диагностик", "эндоскоп", "гастроскоп", "колоноскоп", "ээг", "экг", "эхо", "флюорограф", "маммограф", "доплер", "допплер", "функциональн", "лучев"), "диагностика"),
    (("процедур", "манипуляц", "инъекц", "укол", "капельниц", "массаж", "перевязк", "физиотерап", "операц", "хирург"), "процедура"),
    (("анализ", "лаборатор", "кровь", "крови", "моч", "гематолог", "биохим", "гормон", "иммунолог", "пцр", "пробир", "исследовани", "панель", "генетик", "цитолог", "гистолог", "микробиолог", "соскоб", "мазок"), "лаборатория"),
)
# Specialty substrings -> catalog category.
SPECIALTY_RULES = (
    (("лаборатор", "анализ", "гематолог", "биохим", "микробиолог", "пцр", "иммун", "гистолог", "цитолог"), "Анализы"),
    (("узи", "ультразвук"), "УЗИ"),
    (("мрт", "магнитно-резонанс"), "МРТ/КТ"),
    (("кт", "компьютерная томограф"), "МРТ/КТ"),
    (("рентген", "флюорограф", "маммограф"), "Рентген"),
    (("стоматолог", "ортодонт", "зубн"), "Стоматология"),
    (("прием", "приём", "консультац"), "Приём врача"),
)
# The category of the rest, names that stand for others, tenge for a dollar.
OTHER = "Прочее"
CANON_ALIASES = {"глюкоза (кровь)": "глюкоза (в крови)", "глюкоза (кровь) экспресс": "глюкоза (в крови)"}
# Currency spellings.
CURRENCIES = {"": "KZT", "KZT": "KZT", "ТГ": "KZT", "ТЕНГЕ": "KZT", "ТЕНГЕ.": "KZT", "₸": "KZT", "USD": "USD", "$": "USD", "ДОЛЛАР": "USD"}
USD_RATE = 480
# Panels and their parts.
LIPIDS = ("Холестерин общий", "ЛПНП", "ЛПВП", "Триглицериды")
CLOTTING = ("ПТИ", "МНО", "АЧТВ", "Фибриноген")
PANELS = (("липидограмм", LIPIDS), ("липидный профиль", LIPIDS), ("коагулограмм", CLOTTING), ("гемостазиограмм", CLOTTING))
BILIRUBIN = ("Билирубин общий", "Билирубин прямой", "Билирубин непрямой")
# Cyrillic letters that look Latin in tariff codes, and transliteration of city names.
LOOKALIKE = ("АВСЕКМНОРТХУ", "ABCEKMHOPTXY")
TRANSLIT = {"ж": "zh", "ч": "ch", "щ": "sch", "ш": "sh", "ю": "yu", "я": "ya", "ъ": "", "ь": ""}
TRANSLIT_ONE = ("абвгдеёзийклмнопрстуфхцыэ ", "abvgdeeziiklmnoprstufhcye-")
# Line gate patterns, in the order in which they decide.
SERVICE_HINT = r"(анализ|кров|моч|узи|мрт|кт|рентген|при[её]м|консультац|гормон|витамин|антитела|онкомаркер|глюкоз|холестерин|ттг|оак|оам|пцр|ифа|маз|посев|биохими|коагул|липид|ферритин|билирубин|креатинин|hba1c|hbs|тест\b)"
DIRECTIVE = r"^\s*(направлени\w*\s+(на|для|к)\b|бланк\s+направлени|кому\s+выдан)"
HEADER_WORD = r"^(направлени|результат|исследовани|обследовани|заключени|назначени|бланк|форма|примечани)\w*$"
DATE = r"\b\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}\b"
NOISE_KEY = r"^\s*(пациент|ф\.?и\.?о|фио|дата|время|врач|направлени|направил|кабинет|адрес|телефон|тел|полис|иин|номер|№|клиник|организац|отделени|карта|подпис|печать|диагноз|пол|возраст|email|e-mail)\b"
INSTRUCTION = r"\b(сдат[ьи]|натощак|предостав|результат[ыа]|подготовк|за\s+\d+\s+час|строго\s+натощак|не\s+есть|воздержат|утром\s+нато|по\s+назначени)\b"
NOISE_NAME = r"^\s*(раздел\b|глава\b|прейскурант|приложение|утвержда|согласовано|цена\s+для|цены\s+для|стоимость[,\s]+наимен|наименование\s+услуг|группа\s+сложности|итого\b|всего\b|прайс[-\s]?лист|категория\s+сложн)"
# Words that change the visit or the specimen.
VISIT = (("repeat", r"повторн|вторичн|контрольн|динамическ"), ("online", r"онлайн|дистанцион|телемед|\bonline\b"), ("pediatric", r"детск|ребёнк|ребенк|\bдетей\b|педиатр"))
STOOL = r"\b(кал|кала|кале|калу|копрограмм\w*|копролог\w*|копроцит\w*|фекал\w*|стул)\b"
SPUTUM = r"\bмокрот\w*"
URINE = r"\bмоч[аеиоуы]\w*|\bв\s+моче\b|urin|\bуриа|\bурин"
# How sub-domains of branches of laboratory chains begin.
CHAIN = r"(?i)^(invitro|olimp|olympe?|kdl|gemotest|helix|genom|sinevo|synevo|inco|dnk)[-0-9]"
# Header words of price lists.
NAME_HINTS = ("наименование", "услуг", "название", "процедур", "анализ", "исследован", "name", "service", "атауы", "қызмет")
CODE_HINTS = ("код", "code", "шифр")
NONRES_HINTS = ("нерезидент", "снг", "ближнего зарубежья", "не проживающ", "зарубеж")
RES_HINTS = ("резидент", "постоянно прожива", "оралман", "кандас", "республики казахстан", "граждан рк")
PRICE_HINTS = ("цена", "стоимост", "тариф", "сумма", "прайс", "price", "бағас", "құны", "тенге", "kzt", "ндс")
# Keys of JSON payloads, in the order in which they are tried.
NAME_KEYS = ("name", "service", "title", "наименование", "услуга", "атауы", "service_name")
PRICE_KEYS = ("price", "cost", "amount", "цена", "стоимость", "бағасы", "value")
LIST_KEYS = ("data", "items", "services", "results", "prices", "list")
# Ontology, base key -> (code, group, insured).
ONTOLOGY = (
    ("общий анализ крови", "LAB.HEM.CBC", "Гематология", True),
    ("общий анализ мочи", "LAB.CLIN.UA", "Общеклинические", True),
    ("глюкоза", "LAB.BIO.GLU", "Биохимия", True),
    ("глюкозотолерантный тест", "LAB.BIO.OGTT", "Биохимия", True),
    ("гликированный гемоглобин", "LAB.BIO.HBA1C", "Биохимия", False),
    ("креатинин", "LAB.BIO.CREA", "Биохимия", True),
    ("билирубин общий", "LAB.BIO.TBIL", "Биохимия", True),
    ("холестерин общий", "LAB.BIO.CHOL", "Биохимия", True),
    ("биохимический анализ крови", "LAB.BIO.PANEL", "Биохимия", True),
    ("с-реактивный белок", "LAB.IMM.CRP", "Иммунология", False),
    ("ферритин", "LAB.IMM.FERR", "Иммунология", False),
    ("витамин d", "LAB.IMM.VITD", "Иммунология", False),
    ("ттг", "LAB.HORM.TSH", "Гормоны", False),
    ("приём терапевта", "CONS.GP", "Консультации", True),
    ("приём кардиолога", "CONS.CARD", "Консультации", True),
    ("приём невролога", "CONS.NEUR", "Консультации", True),
    ("приём гинеколога", "CONS.GYN", "Консультации", True),
    ("приём уролога", "CONS.URO", "Консультации", True),
    ("приём эндокринолога", "CONS.ENDO", "Консультации", True),
    ("приём офтальмолога", "CONS.OPHT", "Консультации", True),
    ("приём дерматолога", "CONS.DERM", "Консультации", True),
    ("приём лор-врача", "CONS.ENT", "Консультации", True),
    ("узи брюшной полости", "IMG.US.ABD", "УЗИ", True),
    ("узи почек", "IMG.US.KID", "УЗИ", True),
    ("узи щитовидной железы", "IMG.US.THY", "УЗИ", True),
    ("узи органов малого таза", "IMG.US.PEL", "УЗИ", True),
    ("узи молочных желёз", "IMG.US.BRE", "УЗИ", True),
    ("экг", "FUNC.ECG", "Функциональная диагностика", True),
    ("эхокг", "FUNC.ECHO", "Функциональная диагностика", True),
    ("мрт головного мозга", "IMG.MRI.BRAIN", "Лучевая диагностика", False),
    ("кт головного мозга", "IMG.CT.BRAIN", "Лучевая диагностика", False),
)
SOURCE_PRIORITY = {"upload": 3, "api": 2, "web_scrape": 1}
MATCH, WEAK, REJECT, SEMANTIC, BACKFILL, SUSPECT, SEARCH = 0.78, 0.60, 0.60, 0.72, 0.85, 0.55, 0.70

# Slugs of sources -> slug of the city in the directory.
CITY_ALIASES = {"uk": "ust-kamenogorsk", "semei": "semei", "nur-sultan": "astana", "nursultan": "astana", "almaty": "almaty"}
