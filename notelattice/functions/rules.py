"""Fixed values that results depend on: patterns, word lists, aliases, policies and edge rules."""

# fixed values: entity patterns by type (case-insensitive where listed below), in natural order
PATTERNS = {
    "cve": r"CVE-\d{4}-\d{4,}",
    "intrusion_set": r"\b(?:apt|unc|ta|fin|temp)\s*-?\s*\d+\b",
    "actor": r"\b(?:lazarus|sandworm|volt\s+typhoon)\b",
    "tool": r"\b(?:cobalt\s+strike|metasploit|mimikatz|bloodhound|dropbear|empire|covenant)\b",
    "campaign": r"\b(?:operation\s+\w+)\b",
    "attack_pattern": r"\bT\d{4}(?:\.\d{3})?\b",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "domain": r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+(?:com|net|org|io|co|info|biz|gov|mil|edu|int|ru|cn|de|uk|fr|jp|br|in|au|us|ca|nl|se|ch|es|it|pl|za|kr|tw|mx|ar|cl|no|fi|dk|cz|at|be|pt|ie|nz|il|sg|hk|my|th|ph|vn|id|ua|tr|ro|bg|hr|sk|si|ee|lv|lt|lu|xyz|top|club|online|site|tech|store|app|dev|cloud|pro|cc|me|tv|ws|name|mobi|asia|tel|travel|aero|coop|museum|jobs|cat|post)\b",
    "url": r"https?://[^\s<>\"')\]]+",
    "md5": r"\b[a-fA-F0-9]{32}\b",
    "sha1": r"\b[a-fA-F0-9]{40}\b",
    "sha256": r"\b[a-fA-F0-9]{64}\b",
    "email": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
    "person": r"(?:^|\n)\s*([A-Z][a-z]{2,15}):",
    "location": r"\b(?:New\s+York|Los\s+Angeles|San\s+Francisco|Chicago|London|Paris|Tokyo|Barcelona|Bali|Hawaii|Alaska|Banff|Nashville|Austin|Seattle|Portland|Denver|Miami|Boston|Atlanta|Dallas|Toronto|Vancouver|Sydney|Melbourne|Amsterdam|Rome|Dublin|Edinburgh|Munich|Vienna|Prague|Budapest|Lisbon|Madrid|Singapore|Bangkok|Seoul|Mumbai|Shanghai|Beijing|Dubai|Cairo)\b",
}
#: What any match of the slower patterns begins with, as assertions that cost less; they change no match. A label is all its characters up to a dot.
STARTS = {
    "cve": r"(?=c)",
    "intrusion_set": r"(?=[autf])",
    "actor": r"(?=[lsv])",
    "tool": r"(?=[bcdem])",
    "campaign": r"(?=o)",
    "attack_pattern": r"(?=T)",
    "ipv4": r"(?=\d)",
    "domain": r"\b(?=[a-zA-Z0-9][a-zA-Z0-9-]*+\.)(?=[a-zA-Z0-9.-]*\.[a-z]{2})",
    "email": r"(?=[a-zA-Z0-9._%+-])\b(?=[a-zA-Z0-9._%+-]++@)",
    "location": r"(?=[A-EHLMNPRSTV][aehiloruytmd])",
}
#: What any text with a match contains.
NEEDLES = {"cve": "-", "domain": ".", "ipv4": ".", "url": "://", "email": "@", "person": ":"}
CASELESS = ("cve", "intrusion_set", "actor", "tool", "campaign", "location")
HASH_TYPES = ("md5", "sha1", "sha256")

# fixed values: words that look like speaker names but are not
NAME_STOPWORDS = (
    "the", "and", "but", "for", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "are", "has", "his", "how",
    "note", "text", "content", "context", "session", "conversation", "hey", "wow", "thanks", "yeah", "sure", "well", "really",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may",
    "june", "july", "august", "september", "october", "november", "december",
)

# fixed value: lines that come from code or version control
CODE_CONTEXT = (
    r"(?:[a-zA-Z_]\w*\s*=\s*[\"']?[a-fA-F0-9]{32,64}|\bcommit\s+[a-fA-F0-9]{7,40}\b|\bmerge\s+[a-fA-F0-9]{7,40}\b"
    r"|\btree\s+[a-fA-F0-9]{7,40}\b|\bparent\s+[a-fA-F0-9]{7,40}\b|\bAuthor:\s|```|\bdef\s+\w|[a-zA-Z_]\w*\([^)]*[a-fA-F0-9]{32,64})"
)

# fixed values: keyword stop words and aliases
KEYWORD_STOPWORDS = ("this", "that", "with", "from", "have", "been", "were", "they")
ALIASES = (
    ("actor", "fancy bear", "apt28"),
    ("actor", "pawn storm", "apt28"),
    ("actor", "cozy bear", "apt29"),
)

# fixed values: intent keywords, in the order that breaks ties
INTENT_KEYWORDS = {
    "factual": ["cve-", "cve ", "vulnerability", "exploit", "threat", "what is", "what was", "who is", "name", "identify"],
    "temporal": ["when", "timeline", "since", "before", "after", "changed", "history", "previously", "earlier", "latest", "recent"],
    "relational": [
        "who uses", "who targets", "who conducts", "what tools does", "what malware does", "what technique", "what cve does", "used by",
        "attributed to", "related to", "connected to", "associated with", "linked to", "uses tool", "between", "relationship", "connection",
        "link", "which actor", "which group", "which apt", "what does",
    ],
    "causal": ["why", "because", "caused by", "enables", "leads to", "results in", "due to", "reason for"],
    "exploratory": ["tell me about", "explain", "describe", "overview", "information on", "details about", "context", "summarize", "what do we know", "brief"],
}

# fixed values: weights by intent: vector, entity_index, graph, temporal, top_k
POLICIES = (
    ("factual", 0.3, 0.7, 0.2, 0.0, 3),
    ("temporal", 0.2, 0.1, 0.2, 0.5, 5),
    ("relational", 0.2, 0.2, 0.5, 0.1, 10),
    ("causal", 0.1, 0.1, 0.6, 0.2, 10),
    ("exploratory", 0.5, 0.2, 0.2, 0.1, 10),
    ("unknown", 0.4, 0.2, 0.2, 0.2, 5),
)

# fixed values: days to live by persistence class; a class that is not listed never expires
TTL_DAYS = (("memory", 30), ("wisdom", 90), ("intelligence", 7))

# fixed values: edges between entities of one note: relation, from types, to types
ACTOR_TYPES = ("actor", "threat_actor", "intrusion_set")
EDGE_RULES = (
    *((a, "tool", "USES_TOOL") for a in ACTOR_TYPES),
    *((a, "cve", "EXPLOITS_CVE") for a in (*ACTOR_TYPES, "tool")),
    *((a, "asset", "TARGETS_ASSET") for a in (*ACTOR_TYPES, "tool")),
    *((a, "campaign", "CONDUCTS_CAMPAIGN") for a in ACTOR_TYPES),
    *((a, "attack_pattern", "USES_TECHNIQUE") for a in ACTOR_TYPES),
    ("malware", "attack_pattern", "IMPLEMENTS"),
    ("person", "organization", "AFFILIATED_WITH"),
    ("person", "event", "ATTENDED"),
    ("person", "location", "LOCATED_AT"),
    ("person", "activity", "PARTICIPATES_IN"),
    ("event", "location", "HELD_AT"),
    ("event", "organization", "ORGANIZED_BY"),
    ("event", "temporal", "OCCURRED_ON"),
    ("organization", "location", "BASED_IN"),
)
