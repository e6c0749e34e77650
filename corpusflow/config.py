"""Settings of every stage, and the fixed values that results depend on."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

# Query parameters that never tell pages apart.
STRIP_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "sessionid", "sid", "page", "size", "p", "per_page", "offset", "v", "ver", "version", "_", "t")
# Path extensions that are never fetched.
SKIP_EXTENSIONS = ("pdf", "jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "bmp", "tiff", "zip", "rar", "7z", "tar", "gz", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "mp3", "mp4", "avi", "mov", "wmv", "flv", "mkv", "woff", "woff2", "ttf", "otf", "eot", "css", "js", "json", "xml", "rss", "atom")
DISCOVERY_SKIP_EXTENSIONS = (*SKIP_EXTENSIONS, "crdownload")
# Link prefixes that lead to no page.
SKIP_LINKS = ("mailto:", "tel:", "javascript:", "#")
# Elements that hold no content, and words in class or id that mark boilerplate, in order.
HARD_STRIP = ("script", "style", "noscript", "svg", "iframe", "form", "button", "input", "select", "textarea", "link", "meta")
STRUCTURAL_STRIP = ("nav", "header", "footer", "aside")
BOILERPLATE = ("cookie-consent", "cookie-banner", "gdpr", "advert", "advertisement", "sidebar-widget", "breadcrumb", "social-share", "social-links", "newsletter-signup", "popup-overlay", "pagination", "related-posts", "comment-form", "search-form", "skip-link")
# Fixed values: (pattern, topic) of short questions, in order; the first that is found counts.
EXPANSIONS = (
    ("apply|application|admission|enroll", "admission application process"),
    ("fee|tuition|cost|payment", "fee structure tuition payment"),
    ("faculty|teacher|prof|staff|lecturer", "faculty department teachers"),
    ("program|course|degree|major|curriculum", "program degree course curriculum"),
    ("hostel|transport|sport|library|lab|facility", "facilities hostel transport library labs"),
    ("contact|email|phone|address|location", "contact email phone address"),
    ("scholarship|financial.?aid|stipend", "scholarship financial aid"),
    ("exam|result|grade|marks|gpa", "examination result grades"),
    ("vision|mission|history|introduction", "about vision mission history"),
)
GENERIC_EXPANSION = "overview information"
# Answers that decline.
REFUSALS = ("don'?t have (specific |enough )?information", "outside (my|the) (knowledge|scope)")
#: code, name, direction.
LANGUAGES = (("en", "English", "ltr"), ("ur", "Urdu", "rtl"), ("sd", "Sindhi", "rtl"))
#: Questions that a chat offers at its start, by language.
SUGGESTED = {
    "en": ("What is this site about?", "How do I get in touch?", "What has changed recently?"),
    "ur": ("یہ سائٹ کس بارے میں ہے؟", "رابطہ کیسے کیا جائے؟", "حال ہی میں کیا بدلا ہے؟"),
    "sd": ("هي سائيٽ ڇا بابت آهي؟", "رابطو ڪيئن ڪجي؟", "تازو ڇا تبديل ٿيو آهي؟"),
}


def _positive(**values: float) -> None:
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive, not {value}")


@dataclass(frozen=True)
class CrawlConfig:
    seeds: tuple[str, ...] = ()
    allowed_domains: tuple[str, ...] = ()
    user_agent: str = "corpusflow/1.0"
    max_depth: int = 5
    max_pages: int | None = 800
    timeout_s: float = 25.0
    retries: int = 3
    skip_extensions: tuple[str, ...] = SKIP_EXTENSIONS

    def __post_init__(self) -> None:
        _positive(max_pages=1 if self.max_pages is None else self.max_pages, timeout_s=self.timeout_s)


@dataclass(frozen=True)
class CleanConfig:
    min_content_length: int = 400


@dataclass(frozen=True)
class ChunkConfig:
    max_tokens: int = 500
    min_tokens: int = 200
    overlap_tokens: int = 75
    floor_tokens: int = 100
    min_chars: int = 20
    lossless: bool = False

    def __post_init__(self) -> None:
        _positive(max_tokens=self.max_tokens, min_tokens=self.min_tokens)
        if self.overlap_tokens >= self.max_tokens:
            raise ValueError("overlap_tokens must be less than max_tokens")
        if self.min_tokens >= self.max_tokens:
            raise ValueError("min_tokens must be less than max_tokens")


@dataclass(frozen=True)
class RetrieveConfig:
    top_k: int = 15
    rerank_n: int = 5
    min_vector: float = 0.45
    min_rerank: float = 0.15
    min_query_chars: int = 2
    expansions: tuple[tuple[str, str], ...] = field(default=EXPANSIONS)
    generic: str = GENERIC_EXPANSION


@dataclass(frozen=True)
class AnswerConfig:
    budget_tokens: int = 4000
    max_tokens: int = 900
    max_tokens_once: int = 800
    temperature: float = 0.1
    temperature_unsure: float = 0.25


def from_env(kind: type, prefix: str = "CORPUSFLOW_", env: Mapping[str, str] | None = None):
    """Settings of a kind above with the fields that the environment names, as prefix + FIELD: numbers as
    they are, true or false, lists with commas, an empty value for None. What doesn't parse is an error."""
    env, given = os.environ if env is None else env, {}
    for f in fields(kind):
        said = env.get(prefix + f.name.upper())
        if said is None or f.name == "expansions":
            continue
        given[f.name] = _parsed(f.name, str(f.type), said.strip())
    return kind(**given)


def _parsed(name: str, kind: str, said: str):
    if "tuple" in kind:
        return tuple(x.strip() for x in said.split(",") if x.strip())
    if "None" in kind and not said:
        return None
    if kind == "bool":
        if said.lower() not in ("true", "false"):
            raise ValueError(f"{name} must be true or false, not {said}")
        return said.lower() == "true"
    return int(said) if kind.startswith("int") else float(said) if kind == "float" else said
