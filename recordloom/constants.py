"""Fixed values of the record formats.

Everything in this module is data that stored records, hashes and reports
depend on: enum domains, required field names, transition tables, patterns
and message texts.  None of it is logic.
"""

# --- Threads -----------------------------------------------------------------

THREAD_STATUSES = (
    "PROPOSED",
    "VALIDATED",
    "IMPLEMENTATION",
    "TESTING",
    "COMPLETED",
    "PAUSED",
    "BLOCKED",
    "CANCELLED",
)

ACTION_STATUSES = ("PLANNED", "IN_PROGRESS", "COMPLETED", "BLOCKED", "CANCELLED")

CLOSED_STATUSES = ("COMPLETED", "CANCELLED")

OPEN_ACTION_STATUSES = ("PLANNED", "IN_PROGRESS", "BLOCKED")

THREAD_TRANSITIONS = {
    "PROPOSED": ("VALIDATED", "CANCELLED"),
    "VALIDATED": ("IMPLEMENTATION", "PAUSED", "BLOCKED", "CANCELLED"),
    "IMPLEMENTATION": ("TESTING", "PAUSED", "BLOCKED", "CANCELLED"),
    "TESTING": ("COMPLETED", "IMPLEMENTATION", "PAUSED", "BLOCKED", "CANCELLED"),
    "PAUSED": ("VALIDATED", "IMPLEMENTATION", "TESTING", "CANCELLED"),
    "BLOCKED": ("VALIDATED", "IMPLEMENTATION", "TESTING", "CANCELLED"),
    "COMPLETED": (),
    "CANCELLED": (),
}

QUERY_TYPES = (
    "LIST_THREADS",
    "LIST_OPEN_THREADS",
    "LIST_THREADS_BY_STATUS",
    "GET_THREAD",
    "LIST_THREAD_ACTIONS",
    "LIST_OPEN_ACTIONS",
)

SORT_FIELDS = ("created_at", "updated_at", "started_at", "title", "revision", "status")

MAX_LIMIT = 1000
DEFAULT_LIMIT = 20
DEFAULT_MEMORY_LIMIT = 100

REQUEST_SCHEMA = "0.1"
REQUEST_FIELDS = ("schema_version", "domain", "intent")
REQUEST_FILTERS = (
    "thread_id",
    "status",
    "statuses",
    "title",
    "title_contains",
    "action_id",
    "action_status",
    "action_statuses",
    "relation_type",
    "related_to",
    "provenance",
    "created_after",
    "created_before",
    "updated_after",
    "updated_before",
    "started_after",
    "started_before",
    "include_completed",
    "include_cancelled",
    "sort_by",
    "sort_order",
    "limit",
    "offset",
)

# --- Information -------------------------------------------------------------

INFORMATION_TYPES = (
    "FACT",
    "OBSERVATION",
    "EVENT",
    "HYPOTHESIS",
    "PREDICTION",
    "INTERPRETATION",
    "QUESTION",
    "DECISION",
    "CONSTRAINT",
    "PREFERENCE",
    "CONCEPT",
    "PROCEDURE",
)

EPISTEMIC_STATUSES = (
    "UNKNOWN",
    "UNVERIFIED",
    "CONFIRMED",
    "REFUTED",
    "CONFLICTED",
    "SUPERSEDED",
)

OPERATIONAL_STATES = (
    "ACTIVE",
    "PLANNED",
    "PENDING_REVIEW",
    "CANCELLED",
    "COMPLETED",
    "DEPRECATED",
)

INFORMATION_FIELDS = (
    "id",
    "revision",
    "type",
    "epistemic_status",
    "operational_state",
    "confidence",
    "importance",
    "context",
    "provenance",
    "evidence",
    "time",
    "relations",
    "triggers",
    "retention",
)

REVIEW_DECISIONS = ("CONFIRMED", "REFUTED", "CONFLICTED")

RELATION_TYPES = (
    "SUPPORTS",
    "CONTRADICTS",
    "DERIVED_FROM",
    "DEPENDS_ON",
    "SUPERSEDES",
    "RELATED_TO",
    "PART_OF",
    "INSTANCE_OF",
    "CAUSED_BY",
    "FOLLOWS",
)

REVIEWED_RELATION_TYPES = ("CONTRADICTS", "SUPERSEDES")

SOURCE_TYPES = (
    "USER_STATEMENT",
    "SYSTEM_GENERATED",
    "DIRECT_OBSERVATION",
    "MEASUREMENT",
    "EXPERIMENT",
    "DOCUMENTATION",
    "EXTERNAL_SOURCE",
    "TOOL_OUTPUT",
    "MODEL_OUTPUT",
    "IMPORTED_DATA",
)

TIME_FIELDS = (
    "created_at",
    "observed_at",
    "verified_at",
    "updated_at",
    "valid_from",
    "valid_until",
)

# Keys the quality report asks for (a subset of INFORMATION_FIELDS).
REPORT_FIELDS = (
    "id",
    "revision",
    "type",
    "epistemic_status",
    "operational_state",
    "confidence",
    "importance",
)

# Written specification of epistemic transitions (history checks only).
EPISTEMIC_TRANSITIONS = {
    "UNKNOWN": ("UNVERIFIED",),
    "UNVERIFIED": ("CONFIRMED", "REFUTED", "CONFLICTED"),
    "CONFIRMED": ("SUPERSEDED",),
    "REFUTED": ("SUPERSEDED",),
    "CONFLICTED": ("CONFIRMED", "REFUTED"),
    "SUPERSEDED": (),
}

# Relation entries that make a record associative.
ASSOCIATIVE_MARKER = (
    r"(^|\n)\s*-\s*type:\s*(SUPPORTS|CONTRADICTS|DERIVED_FROM|"
    r"DEPENDS_ON|SUPERSEDES|REQUIRES|CONCERNS)\b"
)

EPISODIC_TYPES = ("OBSERVATION", "EVENT", "MEASUREMENT", "DECISION")
SEMANTIC_TYPES = ("FACT", "CONCEPT", "OBSERVATION", "PROCEDURE")

MECHANISMS = (
    "WORKING",
    "EPISODIC",
    "SEMANTIC",
    "ASSOCIATIVE",
    "PROCEDURAL",
    "PROSPECTIVE",
)

# --- Plans -------------------------------------------------------------------

PLAN_SCHEMA = "0.2"
EXECUTION_SCHEMA = "0.3"
PLAN_OPERATIONS = ("STORE", "UPDATE", "INDEX", "IGNORE")
PLAN_INFORMATION_FIELDS = (
    "identity",
    "classification",
    "context",
    "provenance",
    "evidence",
    "time",
    "relations",
    "triggers",
    "retention",
    "content",
    "source",
)

# Front-matter keys that are not carried over into a plan as free metadata.
EXECUTOR_NAME = "memory-executor"
EXECUTOR_MODE = "DRY-RUN"
PLAN_SAFETY_FLAGS = (
    "embedding_generated",
    "llm_used",
    "qdrant_used",
    "writes_performed",
)
EXECUTION_SAFETY_FLAGS = (
    "embedding_generated",
    "llm_used",
    "qdrant_used",
    "source_file_read",
    "writes_performed",
)

# --- Message texts -----------------------------------------------------------
# They are part of stored plans (and so of their hashes) and of reports.

WORKING_REASON = "Information analysée depuis Working Memory."
EPISODIC_YES_REASON = "type {} compatible avec une expérience ou un événement."
EPISODIC_POSSIBLE_REASON = (
    "Le type ne permet pas de confirmer seul un caractère épisodique."
)
SEMANTIC_CONFIRMED_REASON = (
    "Information confirmée pouvant contribuer à une connaissance réutilisable."
)
SEMANTIC_UNCONFIRMED_REASON = (
    "Type compatible avec Semantic Memory mais état épistémique non confirmé."
)
SEMANTIC_OTHER_REASON = (
    "Classification sémantique non déterminable uniquement par le type."
)
ASSOCIATIVE_YES_REASON = "Une relation mémoire explicite est présente."
ASSOCIATIVE_POSSIBLE_REASON = (
    "Une association peut exister mais aucune relation explicite n'a été détectée."
)
PROCEDURAL_YES_REASON = "Type PROCEDURE détecté."
PROCEDURAL_NO_REASON = "Aucun type PROCEDURE détecté."
PROSPECTIVE_REASON = "Aucun mécanisme prospectif structuré détecté."

STORE_REASON = "Information admissible pour la mémoire persistante."
UPDATE_YES_REASON = "Information explicitement marquée comme révision."
UPDATE_NO_REASON = "Information non explicitement marquée comme révision."
INDEX_YES_REASON = (
    "Au moins un mécanisme mémoire persistant est classifié YES par le composant 21."
)
INDEX_NO_REASON = (
    "Aucun mécanisme mémoire persistant n'est classifié YES par le composant 21."
)
IGNORE_REASON = "Une opération mémoire est requise."

UPDATE_WITHOUT_FLAG = "UPDATE demandé sans revision.is_revision = true."
UPDATE_WITHOUT_PREVIOUS = "UPDATE demandé sans previous_revision."

DECISION_REASONS = {
    "CONFLICT": "operation_id déjà associé à une autre opération logique.",
    "ALREADY_EXECUTED": (
        "Cette opération a déjà été exécutée avec le même Execution Plan."
    ),
    "PARTIAL": (
        "UPDATE partiellement exécutée : Persistent Memory contient déjà "
        "la révision demandée. Finalisation autorisée."
    ),
    "IGNORE_CONTRADICTION": "IGNORE est contradictoire avec une autre opération.",
    "IGNORE_ONLY": "IGNORE est la seule opération requise.",
    "UPDATE_NO_PREVIOUS": "UPDATE demandé sans previous_revision.",
    "UPDATE_ABSENT": "UPDATE demandé mais l'Information persistante n'existe pas.",
    "UPDATE_ALLOWED": "UPDATE demandé et Information persistante existante.",
    "STORE_EXISTS": "STORE demandé mais l'Information existe déjà.",
    "STORE_ALLOWED": "STORE demandé et Information inexistante.",
    "INDEX_ALLOWED": (
        "INDEX demandé. Aucune écriture de contenu n'est effectuée par cette évaluation."
    ),
    "NOTHING": "Aucune opération persistante requise.",
}

STORED_DESCRIPTION = "Information persistée dans Persistent Memory."
UPDATED_DESCRIPTION = "Information mise à jour dans Persistent Memory."
CREATED_DESCRIPTION = "Nouvelle information reçue dans Working Memory."
DECISION_REVIEW_REASON = (
    "Le prototype ne dispose pas encore des mécanismes suffisants "
    "pour valider automatiquement cette information."
)

RELATION_WARNINGS = {
    "CONTRADICTS_FROM_SUPERSEDED": (
        "source SUPERSEDED : contradiction conservée pour traçabilité"
    ),
    "SUPERSEDES_FROM": "source {} : vérifier la pertinence de la supersession",
    "SUPERSEDES_TO_SUPERSEDED": (
        "cible déjà SUPERSEDED : risque de chaîne de supersession"
    ),
    "SUPERSEDES_TO_CONFIRMED": (
        "la supersession ne signifie pas que la cible était fausse"
    ),
}

# Fixed message texts: stored results and reports hold them as they stand.

THREAD_NO_ID = "thread_id is required"
THREAD_NO_TITLE = "title is required"
THREAD_NO_OBJECTIVE = "objective is required"
THREAD_BAD_REVISION = "revision must be >= 1"
THREAD_BAD_STATUS = "invalid Thread status"
THREAD_NO_CREATED = "created_at is required"
THREAD_NO_UPDATED = "updated_at is required"
THREAD_COMPLETED_EARLY = "completed_at must be empty unless status is COMPLETED"
THREAD_NOT_COMPLETED = "completed_at is required for COMPLETED Thread"
ACTION_NO_ID = "action_id is required"
ACTION_NO_DESCRIPTION = "action description is required"
ACTION_REPEATED = "duplicate action_id"

FIELDS_MISSING = "champs absents : "
TYPE_INVALID = "type invalide : "
EPISTEMIC_INVALID = "epistemic_status invalide : "
OPERATIONAL_INVALID = "operational_state invalide : "
ID_EMPTY = "id vide"
FRONT_MISSING = "front matter absent"

RELATION_SOURCE_MISSING = "fichier source introuvable"
RELATION_BAD_TYPE = "relation invalide: "
RELATION_NO_TARGET_ID = "ID cible absent"
RELATION_REFLEXIVE = "relation réflexive interdite pour cette opération"
RELATION_TARGET_MISSING = "information cible introuvable: "
RELATION_BAD_SOURCE_STATE = "état épistémique source invalide: "
RELATION_BAD_TARGET_STATE = "état épistémique cible invalide: "
