"""Fixed values as the SQL of the queries states them, apart from the operators' own.

section 2); nothing imports them from the operators.  So a later change of a value on one side alone shows as rows
that differ.  A slip of both the first copy and that reading would not.
"""

from __future__ import annotations

STOPWORDS = (
    "a an the and or but of to in on at by for with as is was are were be been this that these those from into "
    "over under across it its their our your his her they we you i he she them us"
).split()
# Section names by family.
SECTION_NAMES = [
    "experience|work experience|professional experience|pracovni zkusenosti|zkusenosti|praxe", "academic experience|academic practice|research experience|akademicka praxe",
    "education|vzdelani", "skills|dovednosti|nejcastejsi dovednosti", "languages|jazyky", "certifications|certifikace", "awards|honors-awards|oceneni",
    "publications|publikace", "projects|projekty", "summary|shrnuti", "profile|profil", "contact|kontakt", "grants|granty", "teaching|vyuka", "conferences|konference",
    "references|reference",
]
ALL_CAPS = r"^\p{Lu}[\p{Lu} &/]{6,}$"
BULLET = r"^(?:[-*•·] +|\d{1,3}[.)] +)"
WORK_FAMILIES = ["experience", "academic experience"]
NOT_EMPLOYERS = [
    "community", "case studies", "interests", "leadership", "open source", "portfolio", "side projects", "selected case studies", "selected projects", "volunteer",
    "volunteering",
]
COMPANY_ENDS = [
    " a.s.", " s.r.o.", " corp", " corporation", " gmbh", " group", " inc", " llc", " ltd", " plc",
]
SIDEBAR = [
    "kontakt", "contact", "nejčastější dovednosti", "dovednosti", "skills", "jazyky", "languages", "certifikace", "certifications", "honors-awards",
]
BODY = [
    "pracovní zkušenosti", "professional experience", "work experience", "experience",
]
URL = r"https?://\S+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# Months by their spellings, January first.
MONTHS = [
    "january jan leden ledna", "february feb unor unora", "march mar brezen brezna", "april apr duben dubna", "may kveten kvetna", "june jun cerven cervna",
    "july jul cervenec cervence", "august aug srpen srpna", "september sept sep zari", "october oct rijen rijna", "november nov listopad listopadu",
    "december dec prosinec prosince",
]
PRESENT = "present current now nyni soucasnost soucasne dosud".split()
WORK_HEADINGS = [
    "work experience", "experience", "professional experience", "employment", "employment history", "career", "career history", "pracovni zkusenosti", "zkusenosti",
    "praxe", "zamestnani",
]
OTHER_HEADINGS = [
    "education", "skills", "projects", "personal projects", "publications", "certifications", "certificates", "languages", "hobbies", "interests", "awards", "volunteer",
    "volunteering", "references", "summary", "profile", "about", "about me", "objective", "contact", "vzdelani", "dovednosti", "projekty", "jazyky", "zajmy", "konicky",
    "certifikaty", "publikace", "ocenenia", "reference",
]
# Labels and their words; a star stands for any ending.
SKILLS = [
    ('Python', 'python'), ('SQL', 'sql|postgresql|mysql|bigquery|snowflake'), ('PyTorch', 'pytorch'), ('TensorFlow', 'tensorflow'),
    ('scikit-learn', 'scikit-learn|sklearn'), ('pandas', 'pandas'), ('Spark', 'spark|pyspark|databricks'), ('Airflow', 'airflow'), ('dbt', 'dbt'), ('Docker', 'docker'),
    ('Kubernetes', 'kubernetes'), ('Kafka', 'kafka'), ('MLflow', 'mlflow'), ('LightGBM', 'lightgbm'), ('XGBoost', 'xgboost'), ('Looker', 'looker'), ('Tableau', 'tableau'),
    ('Power BI', 'power bi|powerbi'), ('AWS', 'aws'), ('Azure', 'azure'), ('GCP', 'gcp|google cloud'), ('Terraform', 'terraform'), ('FastAPI', 'fastapi'),
    ('LLM', 'llm|large language model|large language models'), ('RAG', 'rag|retrieval augmented'), ('vector databases', 'vector database|vector databases'),
]
SOFT_SIGNALS = [
    ('leadership', 'led|lead|managed|managed two|řídil|řídila'), ('mentorship', 'mentor*|coached|trained|kouč*|školil'),
    ('stakeholder communication', 'stakeholder*|executive*|presented|communicated|prezentoval*'),
    ('cross-team work', 'cross-team|cross functional|cross-functional|napříč týmy'), ('ownership', 'owned|ownership|accountable|zodpověd*|vlastnil'),
]
# Words of seniority, their band, and whether they manage.
SENIORITY = [
    ('junior', 'junior', False), ('jr', 'junior', False), ('senior', 'senior', False), ('sr', 'senior', False), ('staff', 'staff', False), ('principal', 'staff', False),
    ('lead', 'senior', False), ('head of', 'head', True), ('head', 'head', True), ('director of', 'director', True), ('director', 'director', True),
    ('vp', 'director', True), ('chief', 'director', True), ('manager', 'senior', True), ('manazer', 'senior', True), ('vedouci', 'head', True),
    ('reditel', 'director', True),
]
ROLE_NOUNS = "scientist engineer analyst developer consultant analytik vyvojar".split()
DENIED = [
    "member of staff", "data gardener", "founding engineer", "ai whisperer",
]
BANNED = [
    "phd", "found a startup", "improve communication", "learn more", "network more",
]
DOCTORATE = r"""(?i)(?:^|[^\p{L}\p{N}_])(?:ph\.?\s*d\.?|doctorate|dphil|csc\.?|drsc\.?)(?:[^\p{L}\p{N}_]|$)"""
MASTERS = r"""(?i)(?:^|[^\p{L}\p{N}_])(?:m\.?\s*sc\.?|m\.?\s*eng\.?|master(?:['’]s|s)?|mgr\.?|ing\.|mba)(?:[^\p{L}\p{N}_]|$)"""
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)"
DOMAIN_PRIORITY = [
    "platy.cz", "profesia.cz", "glassdoor", "levels.fyi",
]
# Markets as country, currency and name.
MARKETS = [
    ("CZ", "CZK", "Czech Republic"),
    ("SK", "EUR", "Slovakia"),
    ("PL", "PLN", "Poland"),
    ("HU", "HUF", "Hungary"),
    ("RO", "RON", "Romania"),
    ("BG", "BGN", "Bulgaria"),
    ("DE", "EUR", "Germany"),
    ("AT", "EUR", "Austria"),
    ("FR", "EUR", "France"),
    ("BE", "EUR", "Belgium"),
    ("NL", "EUR", "Netherlands"),
    ("LU", "EUR", "Luxembourg"),
    ("ES", "EUR", "Spain"),
    ("PT", "EUR", "Portugal"),
    ("IT", "EUR", "Italy"),
    ("IE", "EUR", "Ireland"),
    ("FI", "EUR", "Finland"),
    ("EE", "EUR", "Estonia"),
    ("LV", "EUR", "Latvia"),
    ("LT", "EUR", "Lithuania"),
    ("GR", "EUR", "Greece"),
    ("MT", "EUR", "Malta"),
    ("CY", "EUR", "Cyprus"),
    ("SI", "EUR", "Slovenia"),
    ("HR", "EUR", "Croatia"),
    ("CH", "CHF", "Switzerland"),
    ("GB", "GBP", "United Kingdom"),
    ("DK", "DKK", "Denmark"),
    ("NO", "NOK", "Norway"),
    ("SE", "SEK", "Sweden"),
    ("IS", "ISK", "Iceland"),
    ("US", "USD", "United States"),
    ("CA", "CAD", "Canada"),
    ("MX", "MXN", "Mexico"),
    ("BR", "BRL", "Brazil"),
    ("AR", "ARS", "Argentina"),
    ("AU", "AUD", "Australia"),
    ("NZ", "NZD", "New Zealand"),
    ("JP", "JPY", "Japan"),
    ("KR", "KRW", "South Korea"),
    ("CN", "CNY", "China"),
    ("HK", "HKD", "Hong Kong"),
    ("SG", "SGD", "Singapore"),
    ("IN", "INR", "India"),
    ("ID", "IDR", "Indonesia"),
    ("MY", "MYR", "Malaysia"),
    ("PH", "PHP", "Philippines"),
    ("TH", "THB", "Thailand"),
    ("VN", "VND", "Vietnam"),
    ("TR", "TRY", "Türkiye"),
    ("IL", "ILS", "Israel"),
    ("AE", "AED", "United Arab Emirates"),
    ("SA", "SAR", "Saudi Arabia"),
    ("ZA", "ZAR", "South Africa"),
    ("EG", "EGP", "Egypt"),
    ("UA", "UAH", "Ukraine"),
]
