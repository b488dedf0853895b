"""Names, word lists, tables and patterns that results depend on, in natural order."""

from __future__ import annotations

# -- fixed values: predicates ------------------------------------------------
PREDICATES = (
    "uses depends_on implements extends contains belongs_to calls exposes imports references "
    "selected rejected replaced_by deprecated introduces removes "
    "has_reason has_tradeoff has_benefit has_risk has_assumption "
    "requires prohibits allows same_as describes unknown"
).split()
#: Predicates that a statement's free predicate may become; description is describes.
PROMOTED = {p: p for p in PREDICATES if p not in ("belongs_to", "references", "has_assumption", "unknown")} | {"description": "describes"}
#: Predicates of a decision, its rationale or a commitment, in order of presentation.
DECISION_PREDICATES = "selected replaced_by deprecated rejected uses depends_on contains requires has_reason has_tradeoff has_risk has_benefit".split()
DEPENDENCY_PREDICATES = "uses depends_on requires imports calls contains".split()
USE_PREDICATES = "uses depends_on requires imports calls selected".split()
CURRENCY_PREDICATES = "selected uses depends_on".split()
DECLARED_PREDICATES = "replaced_by deprecated".split()
NEGATABLE = "uses imports calls depends_on requires contains".split()
FACT_TYPES = {
    "decision": "selected rejected replaced_by deprecated".split(),
    "constraint": "requires prohibits allows".split(),
    "relationship": "uses depends_on contains implements extends calls exposes imports belongs_to removes introduces".split(),
}

# -- fixed values: artifacts and segments -------------------------------------
AUTHORITY = {"correction": 1.2, "adr": 1.0, "code": 0.9, "pull_request": 0.8, "document": 0.7, "issue": 0.6, "commit": 0.5, "slack": 0.3}
DEFAULT_AUTHORITY = 0.5
TYPE_HINTS = (("adr", "adr"), ("rfc", "document"), ("pr", "pull_request"), ("commit", "commit"), ("issue", "issue"))
#: Words in a heading that type its body; the first row with a hit decides.
HEADER_TYPES = (("status", "status"), ("context|reason|background|problem", "context"), ("decision", "decision"), ("consequence|trade-off|tradeoff", "consequence"))
#: Observation type -> segment kind.
SEGMENT_KINDS = {"reason": "reason", "context": "context", "tradeoff": "tradeoff", "consequence": "consequence", "decision": "decision", "status": "status", "paragraph": "description"}
#: Segment kind -> predicate of the artifact's own statement.
SEGMENT_PREDICATES = {"description": "description", "reason": "has_reason", "tradeoff": "has_tradeoff", "decision": "selected", "context": "has_reason", "status": "describes", "consequence": "has_tradeoff"}
SELF_SUBJECT = "Current Change"
SELF_REFERENCES = ("current change", "$artifact_self")
CONFIDENCE_FLOOR = 0.7
HEDGED, PLAIN = 0.4, 1.0
HEDGES = "should might may could probably likely appears seems possibly perhaps".split()

# -- fixed values: reasons and kinds of edges ------------------------------------
DECLARATION = "Explicit {predicate} declaration"
OCCUPANCY = "Single-occupancy decision supersession"
PREDATES = " (incoming assertion pre-dates stored assertion)"
SIMULTANEOUS = "simultaneous_incompatible_assertions"
NEGATION_CONFLICT = "prohibits_allows_contradiction"
BY_TIME, BY_INGESTION, BY_PERSON = "recorded_at", "ingestion_order", "human_correction"

# -- fixed values: phrases ----------------------------------------------------
#: A phrase ends before these, tried one after the other.
TAIL_MARKERS = (
    " across ", " because ", " since ", " which ", " that ", " while ", " in order to ", " so that ", " when ", " unless ", " rather than ",
    " instead of ", " as part of ", " for all ", " on every ", " after ", " before ", " until ", " once ", " during ", " throughout ",
)
ARTICLES = "the a an our its their".split()
SUBORDINATORS = "because since while although though whereas if when after before unless until as so and but that which".split()
TRAILING_MODIFIERS = (
    "never not may must should shall can could will would might now also always only still then yet already currently explicitly "
    "deliberately simply just longer ever once often sometimes generally no is are was were be been does do did has have"
).split()
PHRASE_EDGES = " .,:;\"'()[]"
STOP_PHRASES = ("it", "this", "that", "them", "us", "we", "everything", "anything", "all services", "all of them")
LEADING_STOPWORDS = (
    "and or but so then thus therefore however that which who whom whose what when where if unless because since while although though "
    "neither either nor not no none any some nothing something anything everything nobody everyone someone anyone everybody much many few several "
    "this these those it they them he she we you each every both all such there here also only just even still yet now never always "
    "be been being is are was were do does did can may might must should would could will"
).split()
DOMAIN_HEADS = (
    "authentication authorization auth encryption validation caching cache logging monitoring tracing metrics service services gateway api apis "
    "endpoint endpoints database store storage queue topic index schema compiler linker resolver parser extractor pipeline module package library "
    "framework component layer memory session token tokens key keys credential credentials request requests response job worker migration deployment "
    "cluster node registry ontology contract contracts test tests suite client server protocol format backend frontend ui cli sdk"
).split()
NON_CONCEPTS = (
    "other others one ones thing things way ways case cases point part parts rest same latter former above below following result results reason "
    "time times end beginning whole window"
).split()
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "cf.", "vs.", "Fig.", "No.")

# -- fixed values: patterns ---------------------------------------------------
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z`\"'(\[])"
CLAUSE_END = r",\s+(?:and|but|while|whereas)\s+|;\s+|\s+(?:and|but)\s+(?=(?:the|a|an|our|its|their)\s+\w)"
NEGATION = r"\b(never|not|cannot|can't|won't|must not|may not|does not|do not|should not|shall not|no longer|neither|nor)\b"
_P = r"([A-Za-z0-9][\w\.\-/ ]{1,90}?)"
_END = r"(?:[\.,;]|$)"
OPERAND = _P
#: name, pattern, predicate, group of the subject, group of the object
RELATIONAL_PATTERNS = (
    ("replace_with", rf"\breplac(?:e|es|ed|ing)\s+{_P}\s+with\s+{_P}{_END}", "replaced_by", 1, 2),
    ("use_for", rf"\bus(?:e|es|ed|ing)\s+{_P}\s+for\s+{_P}{_END}", "selected", 2, 1),
    ("adopt_for", rf"\badopt(?:s|ed|ing)?\s+{_P}\s+for\s+{_P}{_END}", "selected", 2, 1),
    ("migrate_to", rf"\bmigrat(?:e|es|ed|ing)\s+{_P}\s+to\s+{_P}{_END}", "uses", 1, 2),
    ("move_into", rf"\bmov(?:e|es|ed|ing)\s+{_P}\s+(?:into|to)\s+{_P}{_END}", "contains", 2, 1),
    ("remove_from", rf"\bremov(?:e|es|ed|ing)\s+{_P}\s+from\s+{_P}{_END}", "removes", 2, 1),
    ("depends_on", rf"{_P}\s+depends?\s+(?:up)?on\s+{_P}{_END}", "depends_on", 1, 2),
    ("requires", rf"{_P}\s+require[sd]?\s+{_P}{_END}", "requires", 1, 2),
    ("uses", rf"{_P}\s+(?:uses|use|used|using)\s+{_P}{_END}", "uses", 1, 2),
    ("deprecates", rf"\bdeprecat(?:e|es|ed|ing)\s+{_P}\s+in\s+favou?r\s+of\s+{_P}{_END}", "replaced_by", 1, 2),
    ("imports", rf"{_P}\s+(?:may\s+)?imports?\s+{_P}{_END}", "imports", 1, 2),
    ("implements", rf"{_P}\s+implements?\s+{_P}{_END}", "implements", 1, 2),
    ("extends", rf"{_P}\s+extends\s+{_P}{_END}", "extends", 1, 2),
    ("calls", rf"{_P}\s+(?:calls|call)\s+{_P}{_END}", "calls", 1, 2),
    ("contains", rf"{_P}\s+contains\s+{_P}{_END}", "contains", 1, 2),
    ("exposes", rf"{_P}\s+exposes\s+{_P}{_END}", "exposes", 1, 2),
    ("built_on", rf"{_P}\s+(?:is\s+)?(?:built\s+on|sits\s+on\s+top\s+of|runs\s+on|is\s+backed\s+by)\s+{_P}{_END}", "depends_on", 1, 2),
    ("replaces", rf"{_P}\s+(?:now\s+)?replaces\s+{_P}{_END}", "replaced_by", 2, 1),
    ("port_to", rf"\b(?:port|ports|ported|porting|switch|switched|move[sd]?)\s+{_P}\s+(?:to|onto)\s+{_P}{_END}", "uses", 1, 2),
    ("aka", rf"{_P}\s*[\(,]\s*(?:a\.?k\.?a\.?|also\s+(?:known\s+as|called))\s+{_P}\s*[\),\.;]", "same_as", 1, 2),
    ("also_known_as", rf"{_P}\s+is\s+(?:also\s+)?(?:known\s+as|called|referred\s+to\s+as)\s+{_P}{_END}", "same_as", 1, 2),
    ("same_thing_as", rf"{_P}\s+(?:is\s+the\s+same\s+(?:thing\s+)?as|and)\s+{_P}\s+are\s+the\s+same(?:\s+\w+)?{_END}", "same_as", 1, 2),
    ("prefer_over", rf"\b(?:prefer|choose|chose|selected)\s+{_P}\s+over\s+{_P}{_END}", "rejected", 1, 2),
)

# -- fixed values: entities ---------------------------------------------------
#: Known vocabulary, any letter case, with the type of what it finds.
ENTITY_PATTERNS = (
    (r"\bAPI Gateway\b", "component"),
    (r"\bJWT validation\b", "feature"),
    (r"\bauthentication\b", "feature"),
    (r"\b(PostgreSQL|Postgres|Redis|MongoDB|MySQL|SQLite|DynamoDB|Elasticsearch)\b", "database"),
    (r"\b(Kubernetes|K8s|Docker|Terraform|Helm|Ansible)\b", "unknown"),
    (r"\b(React|Vue|Angular|Next\.js|Node\.js|Django|FastAPI|Flask|Spring Boot)\b", "framework"),
    (r"\b(Kafka|RabbitMQ|NATS|Pulsar|AWS SQS)\b", "unknown"),
    (r"\b(OAuth2|OAuth|JWT|gRPC|GraphQL|REST|SAML)\b", "feature"),
)
CAMEL_CASE = r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b"
#: Part of a phrase -> type of the entity; the first hit decides.
ENTITY_HINTS = (
    ("authentication", "capability"), ("authorization", "capability"), ("validation", "capability"), ("caching", "capability"), ("logging", "capability"),
    ("gateway", "component"), ("service", "service"), ("api", "api"), ("database", "database"), ("module", "module"), ("library", "library"),
    ("pipeline", "component"), ("queue", "component"),
)

# -- fixed values: prose ------------------------------------------------------
PHRASING = {
    "selected": "uses {object} for {subject}",
    "rejected": "rejected {object} for {subject}",
    "replaced_by": "replaced {subject} with {object}",
    "deprecated": "deprecated {subject}",
    "uses": "{subject} uses {object}",
    "depends_on": "{subject} depends on {object}",
    "requires": "{subject} requires {object}",
    "prohibits": "{subject} must not use {object}",
    "allows": "{subject} may use {object}",
    "contains": "{subject} contains {object}",
    "implements": "{subject} implements {object}",
    "imports": "{subject} imports {object}",
    "calls": "{subject} calls {object}",
    "exposes": "{subject} exposes {object}",
    "extends": "{subject} extends {object}",
    "removes": "{subject} removes {object}",
    "has_reason": "the stated reason is: {object}",
    "has_tradeoff": "the stated trade-off is: {object}",
    "has_benefit": "the stated benefit is: {object}",
    "has_risk": "the stated risk is: {object}",
}
#: one, several
ARTIFACT_NOUNS = {
    "adr": ("an ADR", "ADRs"),
    "pull_request": ("a pull request", "pull requests"),
    "commit": ("a commit", "commits"),
    "issue": ("an issue", "issues"),
    "document": ("a document", "documents"),
    "slack": ("a Slack message", "Slack messages"),
    "code": ("code", "codes"),
}

# -- fixed values: texts of answers ---------------------------------------------
QUESTION = "Q: what does the project believe about '{name}'?"
UNANSWERABLE = "UNANSWERABLE FROM MEMORY"
UNBOUND = "No entity is registered under the name '{name}'. Memory cannot answer a question about a concept it never bound."
NO_FACTS = "'{name}' is bound (id={ref}) but appears in no persisted fact: recognized as a name, never became knowledge."
NO_DECISION = "'{name}' appears only under predicates {seen}, none of which express a decision or rationale."
NO_HISTORY = "No supersession edge touches this entity: memory holds a current position but no recorded history of what it replaced."
INGESTION_ORDERED = " supersession(s) here were ordered by ingestion order, not by artifact timestamps. Re-importing these artifacts in a different order could invert this answer."
MERGED = "'{name}' resolved across {n} names asserted to be the same concept: {labels}."
TRUNCATED = "The identity class hit the traversal bound; some equivalent names were not followed."
UNDATED = " current fact(s) carry no timestamped evidence."
#: Folders that hold decision records by custom, and files in them that are none.
DECISION_FOLDERS = (
    "docs/adr", "docs/adrs", "docs/architecture-decisions", "docs/decisions", "adr", "adrs", "architecture/decisions", "doc/adr",
    "rfcs", "docs/rfcs", "text", "keps", "designs", "docs/design", "proposals", "docs/proposals",
)
NO_DECISIONS = ("readme", "index", "template")
