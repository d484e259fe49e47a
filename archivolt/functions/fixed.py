"""Word lists, patterns and constants that results depend on."""

# Words that never count as query terms, and two-letter words that do.
STOP_TERMS = (
    "de la el en con por para que se su al es lo como mas o e a y u no si un una unos unas del las los os as me te le ni ya ha he sa pa da re ve"
).split()
SHORT_TERMS = "ia tx hr pc mg iv im sc po".split()

# Words that never become keyword candidates.
STOP_CANDIDATES = (
    "para como este esta estos estas fue ser son hay tiene sin sobre todo entre cuando muy bien puede hace los las del una por que con sus mas "
    "documento documentos datos paciente nombre fecha tipo codigo numero"
).split()

# What counts as a word of a candidate term.
WORD_PATTERN = "[a-záéíóúñü]{4,}"

# Where texts are cut into lines and sentences, and what a heading in capitals is.
BLANK_LINES = r"\n{3,}"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚ])"
HEADING = r"^(?:\d+[.)]\s*)?([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s]{3,60})$"

# Characters to a token, for chunks and for contexts; sizes of chunks and of page groups in tokens.
CHUNK_CHARS, CONTEXT_CHARS = 3, 2.2
CHUNK_TOKENS, CHUNK_OVERLAP, PAGE_GROUP = 500, 50, 1000

# Kinds of personal data in order of masking: kind, pattern, label.
PII = (
    ("dni", r"\b(?:\d{8}[A-J]|[XYZ]\d{7}[A-Z])\b", "[DNI]"),
    ("telefono", r"(?:\+34[\s-]?)?[6789]\d{2}[\s.-]\d{3}[\s.-]\d{3}\b", "[TELEFONO]"),
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL]"),
    ("historia_clinica", r"\b(?:H\s?\.?C\.?|HC| Expediente )\s?\d{4,}\b", "[HISTORIA_CLINICA]"),
    ("tarjeta", r"\b(?:\d[ -]*?){13,16}\b", "[TARJETA]"),
    ("fecha_nacimiento", r"(?:nacid[oa](?: el)?)\s*:?\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "[FECHA_NACIMIENTO]"),
    ("calle", r"\b(?:C/|Calle|Av\.?|Avenida|Paseo|Plaza)\s+[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚñ]*(?:\s+[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚñ]*)*\s*,?\s*(?:n[º°]\s*)?\d+\b", "[DIRECCION]"),
)

# Day, month and year of a birth date.
DATE_PARTS = r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"

# Small talk.
SMALL_TALK = (
    "hola holaa buenas buenos dias tardes noches hey gracias ok okay vale adios chau chao saludos quien eres que haces puedes hacer ayuda ayudame "
    "tal como estas va genial perfecto buenisimo"
).split()
GREETINGS = "hola buenas hey gracias adios chau".split()
CLINICAL = (
    "diagnostic|tratamiento|paciente|sintoma|medicament|dosis|dni|historia|documento|pagina|presion|fiebre|examen|resultado|antecedent|enfermedad|"
    "receta|hospital|seguro|cirug|analisis|informe|fua"
)
REFUSAL = "no (se encuentra|encuentro|dispongo|tengo informaci|hay informaci|puedo (proporcionar|responder))"

# Form labels that are no field values.
FORM_LABELS = (
    "mestizo|mestiza|femenino|femenina|masculino|hombre|mujer|parto|seguro|fallecimiento|natimuerto|salud|materna|paterno|apellido|asegurado|dni|"
    "historia|fecha|documento|atencion|atención|responsable|paciente|nombre"
)

# Roles, other names for them, and their permissions.
ROLES = "admin editor assistant viewer auditor".split()
ROLE_NAMES = {
    "administrador": "admin",
    "especialista": "editor",
    "profesional": "editor",
    "usuario autorizado": "assistant",
    "asistente": "assistant",
    "usuario de consulta": "viewer",
    "consulta": "viewer",
    "auditoría": "auditor",
    "auditoria": "auditor",
}
PERMISSIONS = {
    "admin": (
        "users:create users:read users:update documents:upload documents:update documents:delete documents:read keywords:write keywords:read "
        "query search export audit:read bsc:read alerts:resolve action_plans:write kpis:write chat:read chat:write admin:panel"
    ).split(),
    "editor": (
        "documents:upload documents:update documents:delete documents:read keywords:write keywords:read query search export alerts:resolve "
        "action_plans:write kpis:write chat:read chat:write"
    ).split(),
    "assistant": "documents:read documents:upload keywords:read query search export chat:read chat:write".split(),
    "viewer": "documents:read keywords:read query search chat:read chat:write".split(),
    "auditor": "audit:read documents:read keywords:read query search chat:read chat:write".split(),
}

# Actions that the audit log knows.
AUDIT_ACTIONS = "login login_failed logout register upload update delete search keyword query export admin_action validation error".split()

# Indicators: code, perspective, direction, unit, target, amber, red, kind of query.
KPIS = (
    ("DOC_TOTAL", "conocimiento", "gte", "docs", None, 1.0, 0.0, "doc_total"),
    ("DOC_PROCESSED", "conocimiento", "gte", "%", 98.0, 95.0, 85.0, "doc_processed"),
    ("KEYWORD_COVERAGE", "conocimiento", "gte", "%", 90.0, 90.0, 70.0, "keyword_coverage"),
    ("KEYWORD_GAPS", "conocimiento", "lte", "kw", None, 5.0, 10.0, "keyword_gaps"),
    ("QUERY_TOTAL", "rag", "gte", "q", None, 1.0, 0.0, "query_stats"),
    ("QUERY_WITH_EVIDENCE", "rag", "gte", "%", 90.0, 90.0, 70.0, "query_stats"),
    ("QUERY_NO_EVIDENCE", "rag", "lte", "%", 10.0, 10.0, 30.0, "query_stats"),
    ("USERS_TOTAL", "usuario", "gte", "users", None, 1.0, 0.0, "users_total"),
    ("USAGE_ACTIVE_USERS", "usuario", "gte", "users", None, 1.0, 0.0, "usage_stats"),
    ("USAGE_QUERIES_PER_USER", "usuario", "gte", "q/user", None, 1.0, 0.0, "usage_stats"),
    ("USAGE_DOCS_PER_USER", "usuario", "gte", "docs/user", None, 1.0, 0.0, "usage_stats"),
    ("FEEDBACK_USEFUL", "usuario", "gte", "%", 85.0, 85.0, 70.0, "feedback"),
    ("FEEDBACK_UNUSEFUL", "usuario", "lte", "%", 10.0, 10.0, 30.0, "feedback"),
    ("AUDIT_OPERATIONS", "seguridad", "gte", "ops", None, 1.0, 0.0, "audit_operations"),
    ("FAILED_LOGINS", "seguridad", "lte", "ops", None, 10.0, 50.0, "failed_logins"),
)

# Texts around answers.
NEW_CONVERSATION = "Nueva conversacion"
NO_EVIDENCE = "No dispongo de información suficiente en los documentos indexados para responder esa consulta; no voy a inventar una respuesta."
NO_EVIDENCE_CHAT = (
    "No encuentro evidencia sobre eso en tus documentos. Solo puedo responder sobre el contenido de los documentos cargados; "
    "prueba con una pregunta concreta sobre ellos."
)
HISTORY_HEAD = "[Historial de la conversacion]\n"
CONTEXT_HEAD = "\n\n[Contexto]\n"
CITE_AGAIN = "\n\nIMPORTANTE: cita las fuentes con [1], [2]... correspondientes."
SOURCES_HEAD = "\n\nFuentes consultadas:\n"
