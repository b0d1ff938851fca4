"""Word lists, patterns and thresholds that results depend on."""

# Fixed values. Function words.
STOPWORDS = (
    "a an the and or but if of to in on at by for with from as is are was were be been being it "
    "its this that these those i we you they he she my our your their me us them not no so do does "
    "did will would can could should just than then there here what who whom which when where why "
    "how all any some more most other such only own same too very about into over after before up "
    "down out off also has have had his her him"
).split()

# Fixed values. Words that evaluate without saying anything specific.
GENERIC = (
    "love like liked great good bad nice awesome terrible horrible amazing wonderful excellent "
    "fantastic awful best worst fine happy glad sad agree disagree support oppose hate dislike idea "
    "plan project proposal decision thing stuff way think thought feel felt opinion really totally "
    "definitely yes yeah wow thanks thank please sure just well much"
).split()

# Fixed values. Endings after which a generic word stays generic, with what replaces them; words that are specific for all that.
GENERIC_ENDINGS = (("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"), ("d", ""), ("es", ""), ("s", ""), ("ly", ""))
SPECIFIC = ("fines", "fined", "goods", "wells")

# Fixed values. Frequent function words of Spanish, French, German, Italian and Portuguese that aren't English.
FOREIGN_WORDS = (
    "de en y el la los las del que un una unos por para con es se su sus lo al como pero muy sobre este "
    "esta ser hay nos ya donde cuando porque tambien le les des du et est une dans qui pas sur au aux "
    "avec ce cette sont mais je nous vous ils elle sa ses leur merci der das und ist nicht ein eine mit "
    "auf dem zu sich auch sind wir ich sie werden oder aber wenn noch nur dass il di che gli della "
    "delle sono anche questo questa molto os uma com mais pelo pela muito isso"
).split()

# Fixed values. Slang and what it stands for.
SLANG = {
    "u": "you", "ur": "your", "r": "are", "ppl": "people", "pls": "please", "plz": "please",
    "thx": "thanks", "tbh": "to be honest", "imo": "in my opinion", "imho": "in my opinion",
    "idk": "I do not know", "bc": "because", "cuz": "because", "coz": "because", "b4": "before",
    "n": "and", "w/": "with", "w/o": "without", "gonna": "going to", "wanna": "want to",
    "gotta": "have to", "shud": "should", "cud": "could", "wud": "would", "thru": "through",
    "tho": "though", "st": "street", "govt": "government", "lol": "", "lmao": "", "omg": "",
}

# Fixed values. Letters that look like Latin ones (Cyrillic, Greek, Armenian, other), each above the one it stands for.
LOOK_ALIKES = (
    "аеорсухіјѕԁһӏԛԝүАВЕКМНОРСТХІЈЅ" + "αορνικτυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "օսհոցՕՍ" + "ıȷɑɡ",
    "aeopcyxijsdhlqwyABEKMHOPCTXIJS" + "aopviktucjABEZHIKMNOPTYX" + "ouhngOU" + "ijag",
)

# Fixed values. Invisible characters besides the Unicode format class.
INVISIBLE = "[͏ᅟᅠ឴឵᠋-᠍᠏⠀ㅤ︀-️ﾠ\U000e0100-\U000e01ef]"

# Fixed values. Patterns.
WORD = r"[a-z]+(?:'[a-z]+)?"
CLAUSE_SPLIT = r"[.!?;:]+\s*|,\s+(?:and\s+|but\s+)?|\s+(?:and|but)\s+"
SENTENCE = r"[^.!?;\n]+[.!?;\n]*"
TOKEN = r"[^\W\d_][\w'/]*"

# Fixed values. Limits of texts, and of what counts as foreign.
MAX_ARTICLE_WORDS, MAX_HEADLINE, MIN_BODY, MAX_BODY = 100, 120, 20, 2000
LATIN_MAX_FOREIGN, FOREIGN_SCRIPT = 0.2, 0.3
FULL_LEXICAL_TOKENS = 6
STANCES = ("support", "oppose", "mixed", "undecided")

# Fixed values. What a score's reasons, the admission and the verdict say.
REASONS = {
    "novelty": "novelty z={z:+.2f} vs. corpus (nearest {nearest} @ {sim:.2f})",
    "no clause": "no substantive clause to assess",
    "covered": "every on-topic clause is already covered by existing submissions",
    "copy": "near-copy of {of} ({held:.0%} shingle overlap)",
    "language": "text is not in a supported language (English), so it cannot be assessed",
    "no english": "no assessable English content ({odd} of {n} clauses are not in English)",
    "no content": "no substantive content (no sentence-like clause in the body)",
    "some foreign": "{odd} of {n} clauses are not in English and were not scored",
    "repetitive": "repetitive text",
    "generic": "only {n} specific content word(s): generic comment discounted",
    "no body": "no substantive body to assess relevance",
    "below floor": "relevance {rel:.2f} (margin {margin:+.3f}) is below floor: not rewarded",
    "partial": "relevance {rel:.2f} partially gates the reward ({gate:.2f})",
}
ADMISSION = {
    "copy": "not added: duplicate of {of}",
    "quality": "not added: no substantive content",
    "gate": "not added: off-topic",
    "share": "not added: mostly off-topic ({share:.0%} of the content is on-topic)",
    "added": "added to corpus",
}
VERDICTS = ("Restates the article", "Copy of an existing comment", "Not assessable", "No clear statement", "Off-topic", "New and relevant", "Too general", "Partly new", "Already said")

# Fixed values. Scores that evaluation asks for.
NOVEL_MIN, NOT_NOVEL_MAX, OFF_TOPIC_MAX, LOOSE = 0.6, 0.25, 0.01, 0.05
