"""Vocabularies, taxonomies, weights and field names.

Everything here is a value whose exact text decides a result.  All of it can be
replaced by an argument of the operator that uses it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: taxonomy -------------------------------------------------

CONCENTRATIONS = (
    "Digital Transformation with AI",
    "Data Analytics and AI",
    "Cybersecurity",
    "Information Systems Research in AI",
)

ROLES = (
    "IT Consultant / Tech Risk",
    "Data Analyst / BI Engineer",
    "Cybersecurity Analyst",
    "Product / Project Manager",
    "Software Engineer",
    "Other",
)

CONCENTRATION_ALIASES = {
    "Business Analytics": "Data Analytics and AI",
    "Digital Enterprise Systems": "Digital Transformation with AI",
    "Enterprise Systems": "Digital Transformation with AI",
    "IT Strategy / Consulting": "Digital Transformation with AI",
}

ROLE_CONCENTRATIONS = {
    "IT Consultant / Tech Risk": ("Digital Transformation with AI", "Cybersecurity"),
    "Data Analyst / BI Engineer": (
        "Data Analytics and AI",
        "Information Systems Research in AI",
    ),
    "Cybersecurity Analyst": ("Cybersecurity",),
    "Product / Project Manager": ("Digital Transformation with AI",),
    "Software Engineer": ("Digital Transformation with AI",),
    "Other": (),
}

ROLE_KEYWORDS = {
    "IT Consultant / Tech Risk": (
        "it consultant", "technology consultant", "tech risk", "technology risk",
        "risk advisory", "it audit", "process improvement", "business process",
        "erp consultant", "systems consultant",
    ),
    "Data Analyst / BI Engineer": (
        "data analyst", "business analyst", "bi engineer", "business intelligence",
        "analytics engineer", "reporting analyst", "dashboard", "tableau", "power bi",
        "sql", "data visualization",
    ),
    "Cybersecurity Analyst": (
        "cybersecurity analyst", "security analyst", "cybersecurity",
        "information security", "infosec", "soc analyst", "siem", "splunk", "threat",
        "vulnerability", "nist", "grc",
    ),
    "Product / Project Manager": (
        "product manager", "project manager", "program manager", "product owner",
        "scrum master", "agile", "pmp", "stakeholder management",
    ),
    "Software Engineer": (
        "software engineer", "software developer", "application developer",
        "full stack", "frontend", "backend", "api", "java", "python developer",
        "cloud engineer", "devops",
    ),
}

CONCENTRATION_KEYWORDS = {
    "Digital Transformation with AI": (
        "digital transformation", "ai transformation", "automation",
        "enterprise systems", "erp", "salesforce", "cloud", "agile", "product",
        "project", "consulting",
    ),
    "Data Analytics and AI": (
        "data analytics", "analytics", "business intelligence", "machine learning",
        "ai", "sql", "python", "tableau", "power bi", "dashboard", "forecasting",
    ),
    "Cybersecurity": (
        "cybersecurity", "security", "risk management", "threat", "vulnerability",
        "siem", "nist", "grc", "incident response",
    ),
    "Information Systems Research in AI": (
        "research", "research analyst", "nlp", "natural language processing",
        "literature review", "experiment", "statistical modeling", "r",
        "machine learning", "ai",
    ),
}

# --- fixed values: seniority ------------------------------------------------

SENIORITY_TERMS = (
    ("Senior", ("manager", "director", "lead", "principal", "executive", "head")),
    ("Mid", ("senior", "experienced")),
    ("Entry", ("intern", "internship", "new grad", "entry", "junior", "rotational")),
)
SENIORITY_DEFAULT = "Early/Mid"
STAGE_TO_SENIORITY = (
    ("Entry", ("incoming", "internship", "fall")),
    ("Early/Mid", ("returning", "finishing", "graduate")),
)

# --- fixed values: profile contract -----------------------------------------

NEEDS_SPONSORSHIP = "Need CPT / OPT sponsorship"
PROFILE_ENUMS = {
    "concentration": CONCENTRATIONS,
    "academic_stage": ("Incoming student (Fall)", "Returning / finishing up"),
    "target_roles": ROLES,
    "work_auth_status": ("U.S. Citizen / Green Card", NEEDS_SPONSORSHIP),
    "geo_preference": (
        "Midwest (Chicago, Indy, Cincy)",
        "East Coast (NYC, Boston, DC)",
        "South/Southwest (Austin, Dallas, Atlanta)",
        "West Coast (SF, Seattle, LA)",
        "Open to anywhere",
        "Remote only",
    ),
    "remote_preference": (
        "Remote only", "Hybrid is fine", "On-site is fine", "No preference",
    ),
    "delivery_preference": (
        "Dashboard / spreadsheet view", "Daily or weekly email",
        "Slack / Teams message", "Push notification",
    ),
    "match_frequency": ("Real-time (as they're posted)", "Once a day", "Once a week"),
}
DEFAULT_MATCH_FREQUENCY = "Once a day"

# --- fixed values: ingest ---------------------------------------------------

WRAPPER_KEYS = ("jobs", "data", "results", "postings", "job_postings")
FIELD_ALIASES = {
    "source_job_id": (
        "source_job_id", "job_id", "id", "posting_id", "requisition_id", "req_id",
    ),
    "title": ("title", "job_title", "position_title", "role", "name"),
    "company": (
        "company", "employer", "employer_name", "organization", "company_name",
    ),
    "location": (
        "location", "job_location", "city", "work_location", "office_location",
    ),
    "description": ("description", "job_description", "full_description", "summary"),
    "apply_url": (
        "apply_url", "post_url", "job_url", "url", "application_url", "apply_link",
    ),
    "posted_date": ("posted_date", "date_posted", "created_at", "published_at"),
    "employment_type": (
        "employment_type", "job_type", "position_type", "work_type",
    ),
    "seniority_level": ("seniority_level", "seniority", "experience_level", "level"),
    "concentration_tags": ("concentration_tags",),
    "role_tags": ("role_tags",),
    "opt_cpt_flag": ("opt_cpt_flag",),
}
REQUIRED_FIELDS = ("title", "company", "description", "apply_url")
DEFAULT_LOCATION = "Not specified"
ALIASED_SOURCE_NAME = "ksbit_export"
GENERATED_ID_PREFIX = "ksbit-"
TRUE_WORDS = ("true", "yes", "y", "1")
FALSE_WORDS = ("false", "no", "n", "0")
TRACKING_PARAMS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source")
TRACKING_PREFIX = "utm_"

# (name, status, source_type, priority)
SOURCE_REGISTRY = (
    ("approved_json", "approved", "local_export", 1),
    ("employer_careers", "approved", "sample_employer_careers", 2),
    ("ksbit_export", "approved", "local_export", 3),
    ("handshake", "restricted", "restricted_platform", 99),
    ("linkedin_reference", "manual_reference", "restricted_reference", 99),
)

# --- fixed values: output ---------------------------------------------------

CLASSIFIER_VERSION = "rules-v0"
RANKER_VERSION = "deterministic-v0"
NO_SIGNALS = "No deterministic match signals found"
EXPORT_COLUMNS = (
    "student_id", "student_name", "title", "company", "location", "source",
    "apply_url/post_url", "role_category", "target_role", "concentration_tags",
    "seniority_level", "opt_cpt_flag", "final_score", "score_breakdown",
    "ranking_explanation",
)


@dataclass(frozen=True)
class RankingWeights:
    skill: float = 2.0
    role: float = 3.0
    concentration: float = 2.0
    opt_cpt: float = 1.0
    seniority: float = 1.0
    seniority_mismatch: float = -1.0


@dataclass(frozen=True)
class Taxonomy:
    roles: tuple = ROLES
    concentrations: tuple = CONCENTRATIONS
    aliases: dict = field(default_factory=lambda: dict(CONCENTRATION_ALIASES))
    role_concentrations: dict = field(default_factory=lambda: dict(ROLE_CONCENTRATIONS))
    role_keywords: dict = field(default_factory=lambda: dict(ROLE_KEYWORDS))
    concentration_keywords: dict = field(
        default_factory=lambda: dict(CONCENTRATION_KEYWORDS)
    )
