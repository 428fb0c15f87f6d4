"""Fixed values.

Word lists, patterns, texts and constants that have to equal the known job-ad
workflow's so that results agree. They are defaults of operator parameters.
"""

# --- section headings: (section, list number) -> patterns -------------------
SECTION_KEYWORDS = {
    ("tasks", 1): [
        "Perspektiven", "Aufgaben", "Aufgabengebiet", "Aufgabenschwerpunkte", "Aufgabenbereich",
        "aufgabe", "Dein Job", "Tasks", "Verantwortung", "verantwortungen", "verantworten",
        "beitrag", "bringt der Job", "Tätigkeitsfelder", "Tätigkeit", "Position",
        "helfen kannst", "uns hilfst", "responsibilities", "Herausforderungen",
        "Stellenbeschreibung", "AUFGABENGEBIET", "Rolle", "was in dir steckt", "do",
        "Job Description",
    ],
    ("tasks", 2): ["dich.*erwartet", "erwartet dich", "erwartet sie", "sie.*erwartet"],
    ("profile", 1): [
        "profil", "profile", "hintergrund", "background", "skills", "wir suchen", "wünschen",
        "bringst", "mitbringen", "mitbringst", "bringen sie", "requirements",
        "voraussetzungen", "anforderungen", "qualifikationen", "qualifications",
        "kompetenzen", "macht uns neugierig", "so bist Du", "im gepäck", "wer Sie sind",
        "zeichnet", "darauf freuen wir uns", "auf sie setzen", "uns begeistert",
        "überzeugen", "damit punkten sie", "need",
    ],
    ("benefits", 1): [
        "Angebot", "Vorteile bei uns", ".*Vorteile", "Wir.*bieten", "bieten wir.*",
        ".*bietet Ihnen", "anbieten", "wird.*geboten", "Ihre.*Perspektiven",
        "deine.*Perspektiven", "Benefits", "wohlfühlen", "haben viel vor", "Gute Gründe",
        "Our offer", "we offer", "von uns überzeugen", "Darum wir", "So sind wir", "Darum",
        "Das finden Sie bei uns", "Das findest du bei uns", "WARUM.*", "dich.*freuen",
        "sich.*freuen", "vorteil", "expect",
    ],
    ("benefits", 2): [
        "dich.*erwartet", ".*erwartet dich.*", ".*erwartet sie*", "sie.*erwartet",
        ".*erwartet.*bei", "von.*uns.*erwarten", ".*erwarten kannst",
    ],
    ("benefits", 3): ["zusätzliche informationen"],
    ("contact", 1): [
        "dein weg zu uns", "weitere informationen", "teil.*teams.*werden", "interessiert",
        "interesse", "kontakt", "contact", "werden.*teil", "werde.*teil",
        "Ansprechpartnerin", "ansprechpartner", "ansprechperson", "bewirb Dich", "bewerben",
        "bewerbung", "bewerbungen", "lernen.*kennen", "kennen.*lernen", "kennenzulernen",
        "weg.*uns", "jetzt.*am zug", "erreichst", "erreichen", "wollen.*?", "möchten.*?",
        "neue.*?", "klingt.*?", "Bist Du dabei", "sind sie dabei", "wählen",
        "angesprochen.*?", "herausforderung.*?",
    ],
}
HEADING_LIMIT = 100  # a cell of fewer characters may be a heading
NEXT_CELL_PREFIX = 50  # characters of the next cell that list 3 looks at
MISSING_SECTION = "leer"

# --- title cleaning and filtering -------------------------------------------
GENDER_MARKERS = [
    "(w/m/d)", "(m/w/x)", "(m/f/d)", "(m/w/d)", "(gn)", "(f/m/x)", "(f/m/d)", "(m|w|d|x)",
    "(w|m|d)", "(all genders)", "(m/w/divers)", "m/w/d", "(m/f/x)",
]
TITLE_BLOCKLIST = [
    "CTA", "BTA", "MTLA", "Chemie", "Sozialarbeiter", "Werkstudent", "Praktikum", "befristet",
    "Studium", "außendienst", "therapeut", "Biologielaborant", "Chemielaborant",
]

# --- replacements: (pattern, replacement, columns), applied in this order ----
REPLACEMENTS = [
    ("amp;", "", ["company", "title", "part_1", "part_3", "part_7", "part_9"]),
    ("&nbsp;", " ", ["part_1", "part_3", "part_5", "part_7", "part_9"]),
    ("Chevron bottom icon", " ", ["part_8", "part_9"]),
    ("\n", " ", ["part_1", "part_3", "part_5", "part_7"]),
]

# --- page layout -------------------------------------------------------------
HEADING_TAGS = ["h4", "h2"]  # first that occurs wins
INTRO_MARK, INTRO_LIMIT = "h4", 8
WIDE_PARTS = 11
COMPANY_MARKERS = (r'"header-company-name" target="_blank">', r"<\/a><\/span>")
TITLE_MARKERS = (r'"header-job-title">', r"<\/span><\/div>")
ADDRESS_PATTERN = (
    r'<span class="listing-content-provider-9iwe6r" data-genesis-element="TEXT" '
    r'data-at="address-text">(.+?)</span>'
)
COMPANY_CARD_MARKER = "lccp-companycard-company-btn"
ADDRESS_DROP_PREFIXES = ["Fakten", "http"]
ADDRESS_SIZE_WORDS = ["DEUnternehmensgröße:", "Unternehmensgröße:"]
SEARCH_PATH = (
    "/jobs/%s/in-%s?radius=%s&page=%d"
    "&action=facet_selected%%3bapplicationMethod%%3bINTERNAL&am=INTERNAL"
)
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"
FILE_NAME_FORBIDDEN = r'[/:<>*?"\\|]'

# --- text cleaning -----------------------------------------------------------
UMLAUTS = {"ü": "ue", "Ü": "Ue", "ä": "ae", "Ä": "Ae", "ö": "oe", "Ö": "Oe", "ß": "ss"}

# --- scores and selection ----------------------------------------------------
THRESHOLDS = {"tasks": 0.044, "profile": 0.022, "benefits": 0.0, "total": 0.09}
TOTAL_WEIGHTS = {"tasks": 1.0, "profile": 1.0, "benefits": 0.5}
DONE = "Ja"

# --- default term lists ------------------------------------------------------
PROFILE_TERMS = {
    "tasks": [
        "analyse", "report", "dashboard", "auswertung", "daten", "datenanalyse",
        "datenauswertung", "business", "intelligence", "bi", "kpi", "etl", "data", "warehouse",
        "dwh", "forecast", "zusammenarbeit", "workflow", "prozess", "handlungsempfehlung",
        "Prozessoptimierung", "Datenmengen", "it-affinität", "visualisierung", "Modelle",
        "methoden", "daten-muster", "extrahieren", "datensätze", "reporting",
    ],
    "profile": [
        "analytisch", "studium", "wirtschaft", "ms office", "excel", "datenanalyse", "englisch",
        "fremdsprache", "grundkenntnisse", "sql", "python", "tableau", "flow", "power", "bi",
        "automate",
    ],
    "benefits": [
        "mobiles", "arbeiten", "Home", "Office", "flexibel", "flexible", "gleitzeit", "Hybrid",
        "Philosophie",
    ],
}

# --- output texts ------------------------------------------------------------
LETTER_PREFIX = "Bewerbung_"
SUBJECT_LINE = "Bewerbung um die Stelle als {title}"
SALUTATION = "Sehr geehrte Damen und Herren,"
LETTER_INTRO = (
    "mit großem Interesse habe ich Ihre Stellenausschreibung für einen {title} gelesen. Als "
    "Absolvent der Wirtschaftswissenschaften und derzeitiger Mitarbeiter im Prozessmanagement "
    "bringe ich umfangreiche Kenntnisse und Erfahrungen in der Analyse von Geschäfts- und "
    "IT-prozessen mit. Nun strebe ich an, meine Fähigkeiten und Kompetenzen in den Bereich der "
    "Datenanalyse zu erweitern und bewerbe mich daher bei Ihnen."
)
LETTER_CLOSING = (
    "{about} Mein frühestmögliches Eintrittsdatum is der {start_date}.\nIch bedanke mich für "
    "Ihre Aufmerksamkeit und freue mich sehr auf Ihre Rückmeldung.\n\nMit freundlichen Grüßen,"
)
PLACE_DATE = "{place}, den {today}"
PROMPT = (
    "create a text in german which tasks appeal to me in particular as {title}(not female "
    "perspective)and why the company {company} itself is particular appealing to me in not more "
    "than 130 words: {matched}"
)
MAIL_SUBJECT = "Bewerbung als {title}"
MAIL_BODY = (
    "Sehr geehrte Damen und Herren,\nbitte entnehmen Sie dem Anhang meine Bewerbung um die "
    "ausgeschriebene Stelle als {title}. Dort finden Sie in drei Dokumenten das Anschreiben, "
    "meinen Lebenslauf sowie die Arbeitgeberzeugnisse.\nmit freundlichen Grüßen,\n{name}"
)
