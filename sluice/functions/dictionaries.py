"""Closed vocabularies. All values are fixed: stored slugs and hashes depend on them."""

# Enums, most to least suitable where they are ordered.
WORKPLACE_TYPES = ("REMOTE", "ONSITE", "HYBRID")
JUNIOR_LEVELS = ("ENTRY_LEVEL", "LIKELY_ENTRY_LEVEL", "AMBIGUOUS", "EXPERIENCED", "CLEARLY_EXPERIENCED")
EMPLOYMENT_TYPES = ("FULL_TIME", "PART_TIME", "INTERNSHIP", "CONTRACT", "WORKING_STUDENT")
RUN_STATUSES = ("RUNNING", "SUCCESS", "FAILED")

# Technology slug -> spellings.
TECHNOLOGIES = {
    "java": ("java",), "kotlin": ("kotlin",), "scala": ("scala",), "groovy": ("groovy",), "javascript": ("javascript", "java script", "ecmascript"),
    "typescript": ("typescript", "type script"), "python": ("python",), "ruby": ("ruby",), "php": ("php",), "csharp": ("c#", "c sharp", "csharp"), "cpp": ("c++", "cpp"),
    "golang": ("golang", "go developer", "go engineer", "go programming"), "rust": ("rust",), "swift": ("swift",), "objective-c": ("objective-c", "objective c"),
    "dart": ("dart",), "elixir": ("elixir",), "perl": ("perl",), "bash": ("bash", "shell scripting"), "sql": ("sql",), "html": ("html", "html5"), "css": ("css", "css3"),
    "spring": ("spring", "spring framework"), "spring-boot": ("spring boot", "springboot"), "hibernate": ("hibernate",), "jakarta-ee": ("jakarta ee", "java ee", "j2ee"),
    "quarkus": ("quarkus",), "micronaut": ("micronaut",), "dotnet": (".net", "dotnet", "dot net"), "aspnet": ("asp.net", "asp net"), "entity-framework": ("entity framework",),
    "django": ("django",), "flask": ("flask",), "fastapi": ("fastapi", "fast api"), "laravel": ("laravel",), "symfony": ("symfony",), "rails": ("rails", "ruby on rails"),
    "nodejs": ("node.js", "nodejs", "node js"), "express": ("express.js", "expressjs", "express js"), "nestjs": ("nestjs", "nest.js"), "deno": ("deno",),
    "react": ("react", "react.js", "reactjs"), "react-native": ("react native",), "angular": ("angular", "angularjs"), "vue": ("vue", "vue.js", "vuejs"),
    "svelte": ("svelte", "sveltekit"), "nextjs": ("next.js", "nextjs"), "nuxt": ("nuxt", "nuxt.js"), "redux": ("redux",), "rxjs": ("rxjs",), "jquery": ("jquery",),
    "sass": ("sass", "scss"), "tailwind": ("tailwind", "tailwindcss", "tailwind css"), "bootstrap": ("bootstrap",), "webpack": ("webpack",), "vite": ("vite",),
    "rest-api": ("rest api", "rest apis", "restful"), "graphql": ("graphql",), "grpc": ("grpc",), "kafka": ("kafka", "apache kafka"), "rabbitmq": ("rabbitmq",),
    "postgresql": ("postgresql", "postgres", "psql"), "mysql": ("mysql",), "mariadb": ("mariadb",), "sqlite": ("sqlite",), "sql-server": ("sql server", "mssql", "t-sql"),
    "oracle": ("oracle db", "oracle database", "pl/sql", "plsql"), "mongodb": ("mongodb", "mongo"), "redis": ("redis",),
    "elasticsearch": ("elasticsearch", "elastic search", "opensearch"), "prisma": ("prisma",), "docker": ("docker",), "kubernetes": ("kubernetes", "k8s"),
    "terraform": ("terraform",), "ansible": ("ansible",), "jenkins": ("jenkins",), "github-actions": ("github actions",), "gitlab-ci": ("gitlab ci",), "git": ("git",),
    "linux": ("linux", "unix"), "nginx": ("nginx",), "aws": ("aws", "amazon web services"), "azure": ("azure", "microsoft azure"),
    "gcp": ("gcp", "google cloud", "google cloud platform"), "junit": ("junit",), "jest": ("jest",), "cypress": ("cypress",), "playwright": ("playwright",),
    "selenium": ("selenium",), "pytest": ("pytest",), "pandas": ("pandas",), "numpy": ("numpy",), "tensorflow": ("tensorflow",), "pytorch": ("pytorch",),
    "scikit-learn": ("scikit-learn", "scikit learn", "sklearn"), "spark": ("apache spark", "pyspark"), "hadoop": ("hadoop",), "power-bi": ("power bi",), "tableau": ("tableau",),
    "figma": ("figma",), "jira": ("jira",),
}

# Country code -> spellings, compared folded and without punctuation.
COUNTRIES = {
    "DE": ("germany", "deutschland", "de", "deu"), "AT": ("austria", "österreich", "at", "aut"), "CH": ("switzerland", "schweiz", "suisse", "ch", "che"),
    "GB": ("united kingdom", "great britain", "uk", "gb", "gbr", "england", "scotland", "wales", "northern ireland"), "IE": ("ireland", "irland", "ie", "irl"),
    "NL": ("netherlands", "the netherlands", "niederlande", "nl", "nld"), "BE": ("belgium", "belgien", "be", "bel"), "LU": ("luxembourg", "luxemburg", "lu", "lux"),
    "FR": ("france", "frankreich", "fr", "fra"), "ES": ("spain", "spanien", "españa", "es", "esp"), "PT": ("portugal", "pt", "prt"),
    "IT": ("italy", "italien", "italia", "it", "ita"), "PL": ("poland", "polen", "polska", "pl", "pol"), "CZ": ("czechia", "czech republic", "tschechien", "cz", "cze"),
    "SK": ("slovakia", "sk", "svk"), "HU": ("hungary", "ungarn", "hu", "hun"), "RO": ("romania", "rumänien", "ro", "rou"), "BG": ("bulgaria", "bg", "bgr"),
    "GR": ("greece", "griechenland", "gr", "grc"), "HR": ("croatia", "hr", "hrv"), "SI": ("slovenia", "si", "svn"), "RS": ("serbia", "rs", "srb"), "UA": ("ukraine", "ua", "ukr"),
    "SE": ("sweden", "schweden", "sverige", "se", "swe"), "NO": ("norway", "norwegen", "norge", "no", "nor"), "DK": ("denmark", "dänemark", "danmark", "dk", "dnk"),
    "FI": ("finland", "finnland", "suomi", "fi", "fin"), "EE": ("estonia", "ee", "est"), "LV": ("latvia", "lv", "lva"), "LT": ("lithuania", "lt", "ltu"),
    "US": ("united states", "united states of america", "usa", "us"), "CA": ("canada", "kanada", "ca", "can"), "AU": ("australia", "au", "aus"),
    "NZ": ("new zealand", "nz", "nzl"), "IN": ("india", "indien", "in", "ind"), "TR": ("turkey", "türkiye", "tr", "tur"),
}

# Words that tell German and English apart.
GERMAN_WORDS = [
    "aber", "als", "auch", "auf", "aus", "bei", "beim", "bereits", "bieten", "bietet", "dabei", "damit", "dann", "das", "dass", "dein", "deine", "deinen", "deiner", "dem", "den",
    "der", "des", "dich", "dir", "du", "durch", "ein", "eine", "einem", "einen", "einer", "eines", "es", "für", "fuer", "haben", "ihnen", "ihre", "ihren", "ihrer", "im", "ist",
    "kein", "keine", "keinen", "mehr", "mit", "nach", "nicht", "noch", "oder", "schon", "sehr", "sich", "sie", "sind", "sowie", "suchen", "über", "ueber", "und", "uns", "unser",
    "unsere", "unserem", "unseren", "unserer", "unter", "vom", "von", "vor", "wenn", "werden", "wie", "wir", "wird", "zu", "zum", "zur",
]
ENGLISH_WORDS = [
    "a", "about", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can", "do", "each", "for", "from", "has", "have", "if", "into", "is", "it", "its", "looking",
    "more", "must", "not", "of", "on", "or", "our", "out", "should", "that", "the", "their", "them", "there", "these", "they", "this", "to", "up", "we", "what", "when", "which",
    "who", "with", "you", "your",
]

# Endings of company names that say their legal form.
LEGAL_FORMS = [
    "gmbh", "mbh", "ug", "ag", "kgaa", "kg", "ohg", "gbr", "eg", "ek", "se", "haftungsbeschraenkt", "ltd", "limited", "plc", "llp", "llc", "lp", "inc", "incorporated", "corp",
    "corporation", "company", "co", "pty", "pte", "bv", "nv", "cv", "vof", "bvba", "cvba", "sarl", "sas", "sasu", "sa", "sl", "slu", "srl", "spa", "ab", "oyj", "oy", "asa", "aps",
    "sro", "spzoo", "doo", "dd", "kft", "zrt", "nyrt",
]
LEGAL_PHRASES = ("s a r l", "sp z o o", "sp z oo", "s r o", "d o o", "sa rl", "a s")

# Words of titles.
SENIORITY_WORDS = [
    "junior", "jr", "jnr", "senior", "sr", "snr", "lead", "principal", "staff", "leitender", "leitende", "leitendes",
]
GENDER_WORDS = [
    "m", "w", "f", "d", "x", "n", "h", "g", "gn", "v", "divers", "diverse", "gender", "genders", "geschlecht", "geschlechter", "all", "alle", "any", "jede", "jeder", "neutral",
    "und", "and", "or", "oder", "egal",
]
GENDER_CORE = [
    "m", "w", "f", "d", "x", "gn", "divers", "diverse", "gender", "genders", "geschlecht", "geschlechter",
]

# Phrases, in the order in which they are tried.
NEGATORS = [
    "no", "not", "never", "without", "kein", "keine", "keinen", "keiner", "nicht", "ohne",
]
REMOTE_PHRASES = ("remote", "remotely", "remote work", "remote working", "remote first", "fully remote", "full remote", "100 remote", "work from home", "working from home", "work from anywhere", "home office", "homeoffice", "mobiles arbeiten", "mobile arbeit", "telearbeit", "ortsunabhängig")
ONSITE_PHRASES = ("on site", "onsite", "on location", "in office", "in the office", "in our office", "office based", "im büro", "in unserem büro", "vor ort", "präsenz", "präsenzpflicht", "nicht remote")
HYBRID_PHRASES = ("hybrid", "hybrides arbeiten", "hybrid working", "hybrid work", "hybrid model", "partly remote", "partially remote", "part remote", "teilweise remote", "teilweise im büro")
EMPLOYMENT_PHRASES = {
    "WORKING_STUDENT": ("working student", "werkstudent", "werkstudentin", "werkstudent in", "werkstudierende", "werkstudierender", "werkstudentenstelle", "werkstudentenjob"),
    "INTERNSHIP": ("internship", "internships", "interns", "summer internship", "praktikum", "praktika", "praktikant", "praktikantin", "praktikant in", "pflichtpraktikum", "praxissemester", "industrial placement", "placement year"),
    "CONTRACT": ("freelance", "freelancer", "freelancers", "contractor", "contract role", "contract position", "contract basis", "werkvertrag", "freiberuflich", "freiberufler", "honorarbasis"),
    "PART_TIME": ("part time", "parttime", "teilzeit"),
    "FULL_TIME": ("full time", "fulltime", "vollzeit", "festanstellung", "permanent position", "permanent role"),
}

# HTML.
BLOCK_ELEMENTS = [
    "address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
    "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "tfoot", "thead", "ul",
]
NON_PROSE_ELEMENTS = [
    "script", "style", "noscript", "template", "svg",
]
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "bull": "•", "middot": "·",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "deg": "°", "copy": "©", "reg": "®",
    "trade": "™", "times": "×", "shy": "­", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß",
    "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç",
}

# Letters that fold to other than their base letter.
FOLD_EXPANSIONS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "å": "a", "ł": "l", "đ": "d", "ð": "d", "þ": "th"}
