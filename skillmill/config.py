"""Settings and the fixed lists that results depend on."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _env(name: str, kind: type, default: object) -> object:
    raw = os.environ.get(name, "").strip()
    try:
        return kind(raw) if raw else default
    except ValueError:
        return default


@dataclass(frozen=True)
class Settings:
    """All thresholds and caps in one place; the environment may override them."""

    similarity_threshold: float = 0.6
    max_skills: int = 25
    normalizer_threshold: float = 0.6
    fuzzy_ratio: float = 0.92
    normalizer_max_skills: int = 0
    min_df: int = 5
    max_terms: int = 2000
    html_max_files: int = 0
    pdf_max_files: int = 0
    enable_embeddings: bool = True
    llm_timeout_seconds: float = 60.0
    llm_max_retries: int = 5
    llm_429_backoff_seconds: float = 10.0
    #: Words left out when a dictionary is mined; none named: STOP_WORDS.
    stop_words: frozenset[str] = field(default_factory=frozenset)

    def mining_words(self) -> tuple[str, ...]:
        return tuple(sorted(self.stop_words)) or STOP_WORDS

    @staticmethod
    def from_env() -> Settings:
        return Settings(
            similarity_threshold=_env("SKILL_SIMILARITY_THRESHOLD", float, 0.6),
            max_skills=_env("SKILL_MAX_SKILLS", int, 25),
            normalizer_threshold=_env("SKILL_NORMALIZER_THRESHOLD", float, 0.6),
            fuzzy_ratio=_env("SKILL_NORMALIZER_FUZZY_RATIO", float, 0.92),
            normalizer_max_skills=_env("SKILL_NORMALIZER_MAX_SKILLS", int, 0),
            min_df=_env("SKILL_MIN_DF", int, 5),
            max_terms=_env("SKILL_MAX_TERMS", int, 2000),
            html_max_files=_env("HTML_MAX_FILES", int, 0),
            pdf_max_files=_env("PDF_MAX_FILES", int, 0),
            llm_timeout_seconds=_env("LLM_TIMEOUT_SECONDS", float, 60.0),
            llm_max_retries=_env("LLM_MAX_RETRIES", int, 5),
            llm_429_backoff_seconds=_env("LLM_429_BACKOFF_SECONDS", float, 10.0),
            stop_words=frozenset(_w(_env("SKILL_STOP_WORDS", str, ""))),
            enable_embeddings=str(_env("ENABLE_EMBEDDINGS", str, "true")).lower() in ("1", "true", "yes"),
        )


def _w(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x.strip() for x in text.replace("\n", " ").split(",") if x.strip()))


# Words and phrases by which dictionary terms are kept or dropped.
RESUME_TEXT_COLUMNS = ("Resume_str", "Resume", "resume", "text", "Skills", "skills", "Resume_html", "resume_html", "ResumeHTML")
JOB_TEXT_COLUMNS = ("Job Description", "job_description", "description", "JobDescription")
GENERIC_TERMS = _w(
    "company, role, job, jobs, description, responsibilities, responsibility, requirements, required, experience, skill, skills, candidate, position, work, workplace, "
    "team, teams, training, education, degree, company's, including, ability, using, develop, development"
)
GENERIC_WORDS = _w("skill, skills, experience, responsibility, responsibilities, requirement, requirements, team, work, project, projects")
IMPORTANT_SKILLS = _w("python, sql, java, javascript, react, node, aws, docker, kubernetes, tensorflow, machine learning, deep learning, data science, pandas, numpy")
SHORT_ALIASES = _w("ml, ai, ui, ux, go, r, c, js, ts, py, cs, vb, qt, io, ci, cd, bi")
NOISE_TERMS = _w("company, state, year, years, month, months, week, weeks, day, days, preferred, university, experience, salary, location, remote, full time, part time")
NOISE_PHRASES = ("full time", "part time", "year experience", "years experience", "state university")
MONTHS = _w("january, february, march, april, may, june, july, august, september, october, november, december, jan, feb, mar, apr, jun, jul, aug, sep, sept, oct, nov, dec")
VERB_LIKE = _w(
    "work, worked, working, develop, developed, developing, design, designed, make, made, making, use, used, using, help, helped, helping, manage, managed, managing, lead, led, "
    "leading, responsible, ensure, ensuring, support, supported, collaborate, collaborated, communicate, communicated, build, built, building, create, created, creating, implement, "
    "implemented, maintain, maintained, perform, performed, provide, provided, review, reviewed, analyze, analyzed, deliver, delivered"
)
STOP_WORDS = _w(
    "able, about, above, across, after, again, against, all, also, am, an, and, any, are, as, at, be, because, been, before, being, below, between, both, but, by, can, could, did, do, "
    "does, doing, done, each, few, for, from, further, get, got, had, has, have, having, he, her, here, hers, herself, him, himself, his, how, i, if, in, into, is, it, its, itself, just, "
    "like, me, more, most, my, myself, no, nor, not, now, of, off, on, once, only, or, other, our, ours, ourselves, out, over, own, same, she, should, so, some, such, than, that, the, "
    "their, theirs, them, themselves, then, there, these, they, this, those, through, to, too, under, until, up, very, was, we, were, what, when, where, which, while, who, whom, why, "
    "will, with, would, you, your, yours, yourself, yourselves, good, great, best, strong, excellent, team, teams, time, times, year, years, month, months, week, weeks, day, days, hour, "
    "hours, job, jobs, role, roles, position, candidate, candidates, employer, employee, office, skills, skill, ability, abilities, experience, experiences, responsibilities, "
    "responsibility, requirements, required, preferred, including, etc, various, multiple, several, many, someone, something, well, highly, effective, efficient, successful, new, old, "
    "current, previous, prior, first, second, third, last, next, another, different, similar, related, general, specific, key, main, primary, secondary"
)
CLEANING_STOP_WORDS = tuple(dict.fromkeys(STOP_WORDS + MONTHS + VERB_LIKE))
TECH_WHITELIST = _w(
    "python, java, javascript, sql, aws, docker, kubernetes, linux, react, angular, django, flask, node, git, tensorflow, pytorch, pandas, numpy, tableau, power bi, mysql, postgres, "
    "mongodb, jira, salesforce, sap, quickbooks, oracle, gcp, azure, azure devops"
)
EDUCATION_TERMS = _w("bachelor, bachelors, masters, master, degree, coursework, student, school, college")
SECTION_WORDS = _w("summary, objective, responsibilities, responsibility, profile, resume")
LOCATION_WORDS = _w("states, city, country, india, usa, united states")
GENERIC_ACTIONS = _w("manage, work, perform, complete, conduct, assist, provide, support, handle")
ADJECTIVES = _w("accurate, efficient, strong, excellent, fast, good, dynamic, motivated")
KEPT_PHRASES = _w("data analysis, project management, financial reporting, customer service, risk management, customer support, business analysis")
ACRONYMS = _w("api, sql, etl, sdk, ci, cd, devops, nosql, ml")
PROFESSIONAL_PATTERNS = (
    r"\bproject\s+(management|coordination|planning)\b", r"\bdata\s+analysis\b", r"\bfinancial\s+reporting\b", r"\bcustomer\s+(service|support)\b", r"\brisk\s+management\b",
    r"\b\w+\s+management\b", r"\b\w+\s+reporting\b", r"\b\w+\s+analysis\b", r"\b\w+\s+support\b", r"\b\w+\s+service\b",
)
TECH_KEYWORDS = _w(
    "data, analysis, analytics, data science, machine learning, deep learning, data analysis, development, engineering, deployment, automation, testing, architecture, architect, design, "
    "agile, scrum, kanban, ci cd, continuous integration, continuous delivery, rest, graphql, microservices, api, linux, unix, windows, macos, docker, kubernetes, aws, azure, gcp, react, "
    "angular, django, flask, node, express, spring, hibernate, laravel, rails, ruby, elasticsearch, kafka, redis, postgres, mysql, oracle, mongodb, mssql, tableau, power bi, git, github, "
    "gitlab, jira, salesforce, sap, tensorflow, pytorch, scikit-learn, sklearn, pandas, numpy, matplotlib, seaborn, excel, programming, networking, android, ios"
)
MARKER_TOKENS = _w("data, cloud, software, risk, financial, customer, network, security, project, system, information, machine")
METHOD_ADJECTIVES = _w("agile, scrum, kanban, rest")
SEED_SKILLS = {"python": ("python", "py"), "machine learning": ("machine learning", "ml"), "sql": ("sql", "mysql", "postgres")}
LEVELS = ("beginner", "intermediate", "advanced", "unknown")
PUNCTUATION_DROPPED = "!\"$%&'()*,-/:;<=>?@[\\]^_`{|}~"
