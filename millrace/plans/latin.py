"""Rule sets for Latin-script tables, in the form of the defaults; the registered queries use these."""

NUMBERED = r"^(Th[a-z]+ [a-z]+)"
HEADINGS = ("under", "license", "and the", "le la")
HEADER_WORDS = ("http", "www")
ENDS = ".!?"
SENTENCE_ENDS = ".!?\n"
INTENTS = {
    "financial": ("the", "and|ent", "[0-9]{2}"),
    "risk": (" la ", "que|eau", "ción"),
    "business": (" der ", "sch|ung", " th[a-z]+ "),
    "legal": ("license", "con |para"),
    "management": ("tion", "ment", " of "),
    "comparison": ("ver|vers", "comp"),
    "greeting": (r"^(in|la|der)\b[^.]{0,12}[.]",),
}
YEARS, PHRASES, YEAR_SUFFIX = (("than", -1), ("hand", 0), ("then", -2)), (("ently", "lately"), ("ing", "en")), "AD"
DECOMPOSE = {
    "company": r"([A-Z][a-z]{2,10}(?:on|er|en))",
    "metrics": ("tion", "ment", "keit"),
    "default_metric": "figures",
    "of": " of ",
    "conjunctions": (",",),
    "vague": r" of ([^.,]{2,15}) (?:is|in)",
    "verbs": {"th": ("made ", "kept "), "an": ("won ",)},
    "structure": ("section", "part ", "ou the"),
    "structure_suffix": "below",
    "department": "part",
    "department_as": "structure",
    "facts": ("capital", "ness", "erth"),
    "parents": ("parent", "issuer"),
    "of_company": "the ",
    "of_parent": "the parent ",
    "parent": "parent ",
}
CLARIFY = {"no_time": ("tion", "ment"), "pronouns": (" it ", " he "), "signs": ("th", "en")}
ALIASES = (("north", "Then"), ("north", "Therea"), ("south", "Enen"), ("south", "the"), ("east", "la "), ("west", "der"), ("west", "die "))
BASES = ("north", "south", "east", "west")
ENTITIES = {"COMPANY": DECOMPOSE["company"], "TIME": r"([0-9]{2,4})", "PERCENT": r"([0-9]+ ?%)"}
COMPARISON = "vers"
KEYWORDS = {"ment": ("one", "two"), "tion": ("two", "three"), "sch": ("four",), "que": ("one", "five")}
BY_INTENT = {"business": ("six",), "financial": ("seven", "one")}
SECTIONS = ("one", "two", "three", "four", "five", "six", "seven")
UNROUTED = ("^in ", "over all")
STOPS = "aeo"
