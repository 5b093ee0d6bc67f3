"""Rule data of the corpus: schema, bounds, markers, keywords and sites."""

from __future__ import annotations

# The ten columns of a record, in order.
COLUMNS = ["PSA_ID", "Domain", "English", "Kiswahili", "Ekegusii", "Source", "Date", "URL", "Metadata", "Status"]
# Domains that are valid, and names that stand for one of them.
DOMAINS = ["Health", "Education", "Agriculture", "Security", "Governance"]
DOMAIN_ALIAS = {"Road Safety": "Security"}
# Bounds of a sentence in words, both included.
MIN_WORDS, MAX_WORDS = 4, 80
# Fixed value: the agent's name for fetching.
USER_AGENT = "millrace/1.0"
# Texts that hold one of these, in lower case, are boilerplate.
BOILERPLATE = ("cookie", "subscribe", "all rights reserved", "©", "Ⓒ", "ⓒ", "(c)", "sign up", "log in", "share this", "javascript")
# Keywords of each domain, looked up in this order; the first domain that matches is it.
KEYWORDS = {
    "Health": [
        "health", "doctor", "hospital", "vaccine", "vaccinat", "disease", "medicine", "clinic", "fever", "covid",
        "cholera", "malaria", "wash your hands", "symptom", "patient",
    ],
    "Agriculture": [
        "farm", "crop", "harvest", "seed", "fertilizer", "livestock", "soil", "plant", "maize", "irrigation", "pest",
        "drought",
    ],
    "Security": [
        "police", "security", "emergency", "fire", "accident", "road", "traffic", "safety", "flood", "warning",
        "danger", "evacuate", "curfew",
    ],
    "Education": [
        "school", "student", "teacher", "exam", "learn", "education", "class", "university", "scholarship", "read",
        "book",
    ],
    "Governance": [
        "government", "tax", "vote", "election", "citizen", "license", "permit", "register", "law", "court",
        "ministry", "public", "id card", "passport",
    ],
}
# What the sources are called, where they are, and under what licence.
TICO = {"source": "TICO-19 (Translation Initiative for COVID-19)", "url": "https://tico-19.github.io/", "corpus": "TICO-19", "license": "CC BY 4.0"}
TATOEBA = {"source": "Tatoeba", "url": "https://tatoeba.org/", "corpus": "Tatoeba", "license": "CC BY 2.0 FR"}
# What a site has where it says nothing else.
SITE_DEFAULTS = {"link_patterns": [], "max_pages": 25, "split_sentences": True, "verify_ssl": True, "min_words": MIN_WORDS, "max_records": None, "pagination": None}
# The sites, in order.
SITES = [
    SITE_DEFAULTS | {
        "name": "who_covid_qna",
        "domain": "Health",
        "source": "WHO",
        "start_urls": ["https://www.who.int/news-room/questions-and-answers/item/coronavirus-disease-covid-19"],
        "content_selectors": [".sf-content-block p", "article p", "main p", "p"],
        "max_pages": 15,
    },
    SITE_DEFAULTS | {
        "name": "who_fact_sheets",
        "domain": "Health",
        "source": "WHO",
        "start_urls": ["https://www.who.int/news-room/fact-sheets"],
        "link_patterns": ["/news-room/fact-sheets/detail/"],
        "content_selectors": ["article p", "main p", "p"],
        "max_pages": 100,
    },
    SITE_DEFAULTS | {
        "name": "unicef_parenting",
        "domain": "Health",
        "source": "UNICEF",
        "start_urls": ["https://www.unicef.org/parenting/health"],
        "link_patterns": ["/parenting/"],
        "content_selectors": ["article p", "main p", "p"],
        "max_pages": 15,
    },
    SITE_DEFAULTS | {
        "name": "redcross_news",
        "domain": "Health",
        "source": "Kenya Red Cross",
        "start_urls": ["https://www.redcross.or.ke/category/news", "https://www.redcross.or.ke/blog"],
        "link_patterns": [
            r"redcross\.or\.ke/(?!about-us|careers|contact-us|governance|impact-stories|category|tag|disclaimer|donate|blog|newsletter|get-involved|our-work|comments|feed|wp-)[a-z0-9-]+/?$",
        ],
        "content_selectors": ["article p", "main p", ".entry-content p", "p"],
    },
    SITE_DEFAULTS | {
        "name": "amref_kenya",
        "domain": "Health",
        "source": "Amref Health Africa",
        "start_urls": ["https://amref.org/kenya/news/"],
        "link_patterns": [r"amref\.org/kenya/(?!board-members|consulting|about|contact|careers|donate|news)[a-z0-9-]+/$"],
        "content_selectors": ["article p", "main p", ".entry-content p", "p"],
        "max_pages": 40,
        "pagination": {"template": "https://amref.org/kenya/news/page/{n}/", "start": 2, "pages": 2},
    },
    SITE_DEFAULTS | {
        "name": "ntsa",
        "domain": "Security",
        "source": "NTSA",
        "start_urls": ["https://www.ntsa.go.ke/news"],
        "link_patterns": ["/news/"],
        "content_selectors": ["article p", "main p", ".field-item p", "p"],
        "max_pages": 15,
        "verify_ssl": False,
    },
    SITE_DEFAULTS | {
        "name": "kenya_met",
        "domain": "Security",
        "source": "Kenya Meteorological Department",
        "start_urls": ["https://meteo.go.ke/news"],
        "link_patterns": ["/news/", "/node/"],
        "content_selectors": ["article p", "main p", ".field-item p", "p"],
        "max_pages": 20,
        "verify_ssl": False,
    },
    SITE_DEFAULTS | {
        "name": "kilimo",
        "domain": "Agriculture",
        "source": "Ministry of Agriculture",
        "start_urls": ["https://kilimo.go.ke/category/news/"],
        "link_patterns": [r"kilimo\.go\.ke/\d{4}/", "/category/news/"],
        "content_selectors": ["article p", ".entry-content p", "main p", "p"],
        "max_pages": 20,
        "verify_ssl": False,
    },
    SITE_DEFAULTS | {
        "name": "education_ke",
        "domain": "Education",
        "source": "Ministry of Education",
        "start_urls": ["https://www.education.go.ke/news"],
        "link_patterns": ["/news/", "/node/"],
        "content_selectors": ["article p", "main p", ".field-item p", "p"],
        "max_pages": 20,
        "verify_ssl": False,
    },
    SITE_DEFAULTS | {
        "name": "kra_notices",
        "domain": "Governance",
        "source": "Kenya Revenue Authority",
        "start_urls": ["https://www.kra.go.ke/news-center/public-notices"],
        "link_patterns": ["/news-center/"],
        "content_selectors": ["article p", "main p", ".field-item p", "p"],
        "max_pages": 40,
        "pagination": {"template": "https://www.kra.go.ke/news-center/public-notices?page={n}", "start": 1, "pages": 3},
    },
    SITE_DEFAULTS | {
        "name": "ecitizen",
        "domain": "Governance",
        "source": "eCitizen Kenya",
        "start_urls": ["https://www.ecitizen.go.ke"],
        "content_selectors": ["main p", "article p", "p"],
        "max_pages": 15,
    },
    SITE_DEFAULTS | {
        "name": "nps_kenya",
        "domain": "Security",
        "source": "National Police Service",
        "start_urls": ["https://www.nationalpolice.go.ke/news"],
        "link_patterns": ["/news/"],
        "content_selectors": ["article p", "main p", ".field-item p", "p"],
        "max_pages": 15,
        "verify_ssl": False,
    },
    SITE_DEFAULTS | {
        "name": "infonet_agri",
        "domain": "Agriculture",
        "source": "Infonet-Biovision (Biovision Africa Trust)",
        "start_urls": [
            "https://infonet-biovision.org/crops-fruits-vegetables",
            "https://infonet-biovision.org/animal-health-and-disease",
        ],
        "link_patterns": [
            r"infonet-biovision\.org/(PlantHealth|crops-fruits-vegetables|animal-health-and-disease|indigenous-plants|plant_pests|agro-ecological-zones)/[a-z0-9-]+",
        ],
        "content_selectors": ["article p, article li", "main p, main li", ".field--name-body p, .field--name-body li", "p"],
        "max_pages": 60,
        "min_words": 7,
        "max_records": 2500,
    },
    SITE_DEFAULTS | {
        "name": "nema_insights",
        "domain": "Security",
        "source": "National Environment Management Authority",
        "start_urls": ["https://nema.go.ke/category/insights/article/"],
        "link_patterns": [
            r"nema\.go\.ke/(?!board-of-management|contact-us|county-offices|knowledge-base|nema-departments|category|tag|wp-|about|licensing)[a-z0-9-]+/$",
        ],
        "content_selectors": ["article p", "main p", ".entry-content p", "p"],
        "max_pages": 20,
    },
    SITE_DEFAULTS | {
        "name": "ca_cyber",
        "domain": "Security",
        "source": "Communications Authority of Kenya",
        "start_urls": ["https://www.ca.go.ke/cyber-security"],
        "content_selectors": ["article p, article li", "main p, main li", "p"],
        "max_pages": 5,
    },
    SITE_DEFAULTS | {
        "name": "eacc_news",
        "domain": "Governance",
        "source": "Ethics and Anti-Corruption Commission",
        "start_urls": ["https://eacc.go.ke/default/news/", "https://eacc.go.ke/default/category/news/"],
        "link_patterns": [
            r"eacc\.go\.ke/default/(?!category|tag|wp-content|wp-includes|contact-us|faqs|by-email|by-phone|Downloads|achievements|news/?$)[a-zA-Z0-9-]+/?$",
        ],
        "content_selectors": ["article p", "main p", ".entry-content p", "p"],
        "max_pages": 15,
    },
    SITE_DEFAULTS | {
        "name": "kicd_news",
        "domain": "Education",
        "source": "Kenya Institute of Curriculum Development",
        "start_urls": ["https://kicd.ac.ke/news"],
        "content_selectors": ["article p", "main p", ".item-page p", "p"],
        "max_pages": 5,
    },
]
