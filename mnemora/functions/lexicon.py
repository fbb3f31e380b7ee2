"""Word lists, patterns and rules. All in this module are fixed values: results depend on them exactly."""

STOPWORDS = (
    "a an the of in on at to for from by with and or but is are was were be been being did do does done has have had it its this "
    "that these those as into than then there their they he she his her we our you your i me my not no if so such can could would "
    "should will shall may might must also all any each every both more most other some very who whom what when why how which where "
    "about after before during per up out over"
).split()

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Sept|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE = rf"\b(?:\d{{4}}-\d{{2}}-\d{{2}}|(?:{MONTHS})\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}|\d{{1,2}}(?:st|nd|rd|th)? (?:{MONTHS})\.?,? \d{{4}}|(?:{MONTHS})\.? \d{{4}})\b"

ENTITY_TYPES = "PERSON ORGANIZATION COMMITTEE DEPARTMENT EVENT MEETING DECISION REASON ACTION DATE DOCUMENT".split()
ENTITY_ALIASES = {
    "ORG": "ORGANIZATION", "INSTITUTION": "ORGANIZATION", "UNIVERSITY": "ORGANIZATION", "COLLEGE": "ORGANIZATION", "PEOPLE": "PERSON", "INDIVIDUAL": "PERSON",
    "BOARD": "COMMITTEE", "COUNCIL": "COMMITTEE", "DEPT": "DEPARTMENT", "DOC": "DOCUMENT", "RESOLUTION": "DECISION", "TASK": "ACTION", "ACTION_ITEM": "ACTION",
    "RATIONALE": "REASON", "JUSTIFICATION": "REASON",
}
RELATION_ALIASES = {
    "APPROVED": "APPROVED_BY", "APPROVES": "APPROVED_BY", "REJECTED": "REJECTED_BY", "PROPOSED": "PROPOSED_BY", "DEFERRED": "DEFERRED_BY", "HELD": "HELD_ON",
    "DECIDED_IN": "DECIDED_AT", "DECIDED_DURING": "DECIDED_AT", "JUSTIFIED": "JUSTIFIED_BY", "REASON": "JUSTIFIED_BY", "BECAUSE_OF": "JUSTIFIED_BY",
    "RESULTED_IN": "LED_TO", "ASSIGNED": "ASSIGNED_TO", "RESPONSIBLE_FOR": "ASSIGNED_TO", "ATTENDEE_OF": "ATTENDED", "SUPERSEDED": "SUPERSEDES",
    "ORGANIZED": "CONVENED", "ORGANISED": "CONVENED",
}
_GROUPS, _MEET = "COMMITTEE DEPARTMENT ORGANIZATION", "MEETING EVENT"
_ACTORS = _GROUPS + " PERSON"
#: relation: (source types, target types); empty: any
RELATION_RULES = {
    "HELD_ON": (_MEET, "DATE"), "CONVENED": (_GROUPS, _MEET), "ATTENDED": ("PERSON", _MEET), "CHAIRED": ("PERSON", _MEET + " COMMITTEE"), "MEMBER_OF": ("PERSON", _GROUPS),
    "PART_OF": (_GROUPS, _GROUPS), "PROPOSED_BY": ("DECISION", _ACTORS), "APPROVED_BY": ("DECISION", _ACTORS), "REJECTED_BY": ("DECISION", _ACTORS),
    "DEFERRED_BY": ("DECISION", _ACTORS), "DECIDED_AT": ("DECISION", _MEET), "DECIDED_ON": ("DECISION", "DATE"), "JUSTIFIED_BY": ("DECISION", "REASON"),
    "LED_TO": ("DECISION", "ACTION"), "ASSIGNED_TO": ("ACTION", _ACTORS), "DUE_ON": ("ACTION", "DATE"), "FOLLOWS_UP": ("DECISION", "DECISION"),
    "SUPERSEDES": ("DECISION", "DECISION"), "MENTIONED_IN": ("", "DOCUMENT"), "RELATED_TO": ("", ""),
}
#: decision relation: kind of step, verb
OUTCOMES = {"PROPOSED_BY": ("PROPOSED", "proposed"), "APPROVED_BY": ("APPROVED", "approved"), "REJECTED_BY": ("REJECTED", "rejected"), "DEFERRED_BY": ("DEFERRED", "deferred")}
DATED_ORDER = {"PROPOSED": 0, "MEETING": 1, "DECIDED": 2, "APPROVED": 3, "REJECTED": 3, "DEFERRED": 3}
UNDATED_ORDER = {"APPROVED": 0, "REJECTED": 0, "DEFERRED": 0, "PROPOSED": 0, "MEETING": 1, "DECIDED": 1, "REASON": 2, "ACTION": 3, "RELATED_DECISION": 4}

PERSON = r"\b(?:Dr|Prof|Mr|Mrs|Ms|Shri|Smt)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)*"
BODY = r"\b(?:(?:[A-Z][A-Za-z&]+ )*Board of Governors|(?:[A-Z][A-Za-z&]+ )+(?:Council|Committee|Senate|Department(?! of\b))|Department of [A-Z][A-Za-z&]+(?: [A-Z][A-Za-z&]+)*)\b"
ORGANIZATION = r"\b(?:[A-Z][a-z]+ )+(?:College|University|Institute)\b"
MEETING = r"\b(?:met|convened|held (?:a|its) meeting)\b"
DECISION = r"\b(approved|ratified|endorsed|rejected|deferred|proposed)\s+(.+?)(?=\s+(?:on|because|due to|owing to|as|by|after|during|at|recommended)\b|[,;.]|$)"
REASON = r"\b(?:because|due to|owing to)\s+(.+?)\s*(?:[;.]|$)"
ACTION = r"\b(?:was|is|were|are)\s+(?:tasked with|tasked to|assigned to|responsible for|directed to|asked to|requested to)\s+"
VERB_RELATION = {"approved": "APPROVED_BY", "ratified": "APPROVED_BY", "endorsed": "APPROVED_BY", "rejected": "REJECTED_BY", "deferred": "DEFERRED_BY", "proposed": "PROPOSED_BY"}
VAGUE = "it this that them these those proposal motion resolution recommendation plan request".split()
ABBREVIATIONS = r"\b(Dr|Prof|Mr|Mrs|Ms|Shri|Smt|St|No)\."

# Leading words that a decision's object is stripped of, and the signs of attendance, membership and consequence in a sentence.
OBJECT_LEADS = (
    r"(?i)^(?:the|a|an)\s+", r"(?i)^(?:proposal|proposed|recommendation|motion|resolution|plan)\s+(?:to|for|of|on)\s+",
    r"(?i)^(?:introduction|establishment|creation|launch)\s+of\s+",
)
ATTENDED, MEMBERS = r"\b(?:attended|attendees|present|participated)\b", r"\bmember of\b"
FOLLOWS = r"\b(?:this|the) decision\b|\bto implement\b"

# Words of a question that say what is asked, and words for kinds of bodies; neither is what the question is about.
GENERIC = (
    "approve approved approves approval approving decide decided decides deciding decision decisions reject rejected rejects rejection "
    "propose proposed proposes proposal proposals defer deferred defers resolve resolved resolution ratify ratified endorse endorsed "
    "reason reasons rationale justification justified justify because meeting meetings happen happened happening held date dates made "
    "make makes take taken took give given gave result results outcome outcomes history timeline trail chronological chronology list "
    "show tell explain describe summarize summarise summary overview please due deadline deadlines deliver delivered related relate "
    "relates relating about regarding concerning concern concerns month months year years day days week weeks recent latest earlier "
    "later previous follow follows followed supersede supersedes superseded so very really actually exactly specifically currently "
    "finally ultimately eventually mainly mostly just only still yet then thus hence"
).split()
ROLES = "committee council board department college university institute senate organization organisation member members faculty office cell unit".split()

# What a question asks for.
ASKS = {
    "decide": r"\b(?:decid\w*|approv\w*|reject\w*|defer\w*|resolv\w*|ratif\w*|endors\w*)\b", "decision": r"\bdecisions?\b", "propose": r"\bpropos\w*",
    "due": r"\b(?:due|deadlines?|deliver\w*)\b", "why": r"\b(?:why|reasons?|rationale|justif\w*|because)\b",
    "listing": r"\b(?:list|all|every|decisions|timeline|history|chronolog\w*|overview|summar\w*|recent|latest|so far)\b",
    "history": r"\b(?:history|timeline|chronolog\w*|related|relate\w*|follow\w*|supersed\w*|previous\w*|earlier|precede\w*)\b",
    "APPROVED": r"\bapprov\w*", "REJECTED": r"\breject\w*", "DEFERRED": r"\bdefer\w*",
}
EVENT_KINDS = {"decide": ("APPROVED", "REJECTED", "DEFERRED", "DECIDED", "MEETING"), "propose": ("PROPOSED",), "due": ("DUE",)}
MENTIONED = ("COMMITTEE", "DEPARTMENT", "ORGANIZATION", "PERSON", "EVENT")
# Shares of a topic's weight that must hit a decision's name, or its name and reasons; share of the best score; sentences shown.
DIRECT, SUPPORT, KEEP, SENTENCES = 0.5, 0.6, 0.75, 12
