"""Controlled vocabularies.  All of these are fixed values that results depend on, in the order that they are defined in."""

ENTITY_TYPES = ("PERSON", "ORGANISATION", "COMPANY", "POLITICAL_PARTY", "COMMITTEE", "PARLIAMENT", "GOVERNMENT_BODY", "EVENT", "INITIATIVE", "ASSOCIATION", "MEDIA_OUTLET", "LOCATION", "COUNTRY", "OTHER")
ORG8 = ("ORGANISATION", "COMPANY", "POLITICAL_PARTY", "COMMITTEE", "PARLIAMENT", "GOVERNMENT_BODY", "ASSOCIATION", "MEDIA_OUTLET")
CONNECTION_CLASSES = ("DIRECT", "INDIRECT", "OFFICIAL", "HISTORICAL")
STATUSES = ("DETECTED", "PENDING_REVIEW", "VERIFIED", "REJECTED", "DISPUTED", "OUTDATED")
SOURCE_TYPES = ("OFFICIAL_REGISTER", "PARLIAMENT", "GOVERNMENT", "COMPANY_REGISTER", "COMPANY_WEBSITE", "ORGANISATION_WEBSITE", "NEWS_ARTICLE", "PRESS_RELEASE", "EVENT_PROGRAM", "PDF", "SOCIAL_MEDIA", "MANUAL_RESEARCH", "OTHER")
ACCESS_STATUSES = ("PUBLIC", "PAYWALLED", "BLOCKED", "LOGIN_REQUIRED", "REMOVED", "UNKNOWN")
EXTRACTION_STATUSES = ("PENDING", "SUCCESS", "PARTIAL", "METADATA_ONLY", "FAILED")
SOURCE_QUALITIES = ("A", "B", "C", "D", "E", "X")
CANDIDATE_STATUSES = ("DETECTED", "PENDING_REVIEW", "DISPUTED")
ROLES = ("ADMIN", "RESEARCHER", "REVIEWER", "PUBLIC")

_P, _O, _C, _PP, _GB, _A, _I, _E = "PERSON", "ORGANISATION", "COMPANY", "POLITICAL_PARTY", "GOVERNMENT_BODY", "ASSOCIATION", "INITIATIVE", "EVENT"
#: predicate: (subject types, object types)
COMPATIBLE = {
    "MEMBER_OF": ((_P, _O, _C), ORG8),
    "PRESIDENT_OF": ((_P,), ORG8),
    "VICE_PRESIDENT_OF": ((_P,), ORG8),
    "BOARD_MEMBER_OF": ((_P,), (_C, _O, _A)),
    "EMPLOYED_BY": ((_P,), ORG8),
    "OWNS": ((_P, _C, _O), (_C, _O)),
    "SHAREHOLDER_OF": ((_P, _C, _O), (_C,)),
    "HAS_MANDATE_AT": ((_P, _C, _O), ORG8),
    "MEMBER_OF_COMMITTEE": ((_P,), ("COMMITTEE",)),
    "PARTICIPATED_IN": ((_P, *ORG8), (_E,)),
    "ORGANISED_BY": ((_E,), (_P, *ORG8)),
    "SPOKE_AT": ((_P,), (_E,)),
    "MET_WITH": ((_P, _O, _C, _PP, _GB), (_P, _O, _C, _PP, _GB)),
    "REPRESENTED": ((_P, _O, _C, _PP), (_P, *ORG8)),
    "FUNDED_BY": ((_P, _O, _C, _PP, _E, _I, _A), (_P, _O, _C, _PP, _A)),
    "SUPPORTED_INITIATIVE": ((_P, _O, _C, _PP, _A), (_I,)),
    "SIGNED_DECLARATION": ((_P, _O, _C, _PP, _A), ("OTHER", _I)),
    "HAS_BUSINESS_ACTIVITY_IN": ((_P, _O, _C, _A), ("LOCATION", "COUNTRY")),
    "ISSUED_ACCESS_BADGE_TO": (("PARLIAMENT", _GB), (_P,)),
    "ADVISOR_TO": ((_P, _O, _C), (_P, _O, _C, _PP, _GB)),
    "FOUNDED": ((_P, _O, _C), (_O, _C, _PP, _A, "MEDIA_OUTLET")),
    "PARTNER_OF": ((_P, _O, _C, _PP, _A), (_P, _O, _C, _PP, _A)),
}
PREDICATES = tuple(COMPATIBLE)


def compatible_rows() -> list[tuple[str, str, str]]:
    """(predicate, subject type, object type): a relation of fixed size, to be broadcast."""
    return [(p, s, o) for p, (subjects, objects) in COMPATIBLE.items() for s in subjects for o in objects]


#: Phrases, normalised, that express a predicate; spellings that normalise alike stand once.
CUES = {
    "MEMBER_OF": ("member of", "mitglied", "gehort zu"),
    "PRESIDENT_OF": ("president of", "prasident", "vorsitz"),
    "VICE_PRESIDENT_OF": ("vice president", "vizeprasident"),
    "BOARD_MEMBER_OF": ("board member", "verwaltungsrat", "vorstandsmitglied"),
    "EMPLOYED_BY": ("employed by", "arbeitet bei", "angestellt", "employee"),
    "OWNS": ("owns", "owner", "besitzt", "eigentumer"),
    "SHAREHOLDER_OF": ("shareholder", "aktionar", "beteiligung"),
    "HAS_MANDATE_AT": ("mandate", "mandat", "auftrag"),
    "MEMBER_OF_COMMITTEE": ("committee member", "kommissionsmitglied", "mitglied der kommission"),
    "PARTICIPATED_IN": ("participated in", "took part", "nahm teil", "teilgenommen", "besuchte", "teil"),
    "ORGANISED_BY": ("organized by", "organised by", "organisiert von", "veranstaltet von"),
    "SPOKE_AT": ("spoke at", "sprach an", "sprach bei", "referierte"),
    "MET_WITH": ("met with", "traf", "treffen mit", "meeting with"),
    "REPRESENTED": ("represented", "vertrat", "representative", "vertreter"),
    "FUNDED_BY": ("funded by", "finanziert von", "unterstutzt von"),
    "SUPPORTED_INITIATIVE": ("supported initiative", "unterstutzte die initiative"),
    "SIGNED_DECLARATION": ("signed", "unterzeichnete", "signatory"),
    "HAS_BUSINESS_ACTIVITY_IN": ("business activity", "geschaftstatigkeit"),
    "ISSUED_ACCESS_BADGE_TO": ("access badge", "zutrittsbadge", "badge"),
    "ADVISOR_TO": ("advisor", "berater", "beriet"),
    "FOUNDED": ("founded", "grundete"),
    "PARTNER_OF": ("partner", "partnership", "partnerschaft"),
}
NEGATIONS = ("not", "never", "no longer", "kein", "keine", "nicht", "niemals", "nie", "nest pas", "pas membre")
CONTRADICTIONS = ("contradicted", "denied", "disputed", "false", "no evidence", "widersprach", "bestritt", "dementierte", "widerlegt", "falsch")
#: "gema" is what the spelling with a sharp s normalises to.
ATTRIBUTIONS = ("said", "claimed", "according to", "alleged", "sagte", "behauptete", "laut", "gemass", "gema")
SENSITIVE = ("russia", "russland", "russian", "waffen", "arms", "rustung", "ruestung", "extremismus", "extremism", "korruption", "corruption", "financial interest", "finanzielles interesse")
