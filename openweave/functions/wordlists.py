"""Word lists and patterns whose values are given by the behaviour to be matched."""

# Everyday English words of the content filter.
COMMON_ENGLISH = frozenset(
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would there their what so up out if about who get which go me "
    "when make can like time no just him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well way "
    "even new want because any these give day most us is are was were been being has had did does very more much many such here where why yes".split()
)
# Answers that say nothing (the whole trimmed, lower-cased answer must match).
NON_ANALYTIC = (
    r"^n/?a$", r"^none\.?$", r"^nothing\.?$", r"^no\s*(comment|response|answer)?\.?$", r"^idk\.?$", r"^i\s*don'?t\s*know\.?$",
    r"^test\.?$", r"^asdf+$", r"^(.)\1{2,}$", r"^\.+$", r"^-+$", r"^\s*$",
)
# Contractions and their long forms.
CONTRACTIONS = {
    "aren't": "are not", "can't": "cannot", "couldn't": "could not", "didn't": "did not", "doesn't": "does not", "don't": "do not", "hadn't": "had not", "hasn't": "has not",
    "haven't": "have not", "he'd": "he would", "he'll": "he will", "he's": "he is", "i'd": "i would", "i'll": "i will", "i'm": "i am", "i've": "i have", "isn't": "is not",
    "it'd": "it would", "it'll": "it will", "it's": "it is", "let's": "let us", "mightn't": "might not", "mustn't": "must not", "shan't": "shall not", "she'd": "she would",
    "she'll": "she will", "she's": "she is", "shouldn't": "should not", "that's": "that is", "there'd": "there would", "there's": "there is", "they'd": "they would", "they'll": "they will",
    "they're": "they are", "they've": "they have", "we'd": "we would", "we'll": "we will", "we're": "we are", "we've": "we have", "weren't": "were not", "what'll": "what will",
    "what're": "what are", "what's": "what is", "what've": "what have", "where'd": "where did", "where's": "where is", "who'd": "who would", "who'll": "who will", "who're": "who are",
    "who's": "who is", "who've": "who have", "won't": "will not", "wouldn't": "would not", "you'd": "you would", "you'll": "you will", "you're": "you are", "you've": "you have",
    "ain't": "is not", "gonna": "going to", "gotta": "got to", "wanna": "want to", "kinda": "kind of", "sorta": "sort of", "coulda": "could have", "woulda": "would have",
    "shoulda": "should have", "musta": "must have", "lemme": "let me", "gimme": "give me", "dunno": "do not know", "y'all": "you all", "c'mon": "come on", "ma'am": "madam",
    "o'clock": "of the clock", "'cause": "because", "how'd": "how did", "how'll": "how will", "how's": "how is", "when's": "when is", "why'd": "why did", "why's": "why is",
}
# Chat abbreviations (expanded only on request).
SLANG = {
    "lol": "laughing out loud", "lmao": "laughing my ass off", "lmfao": "laughing my fucking ass off", "rofl": "rolling on floor laughing", "brb": "be right back", "btw": "by the way",
    "imo": "in my opinion", "imho": "in my humble opinion", "tbh": "to be honest", "ngl": "not gonna lie", "idk": "i do not know", "omg": "oh my god", "omfg": "oh my fucking god",
    "wtf": "what the fuck", "wth": "what the heck", "smh": "shaking my head", "fyi": "for your information", "afaik": "as far as i know", "iirc": "if i recall correctly",
    "tldr": "too long did not read", "tl;dr": "too long did not read", "irl": "in real life", "ikr": "i know right", "nvm": "never mind", "ftw": "for the win",
    "fwiw": "for what it is worth", "ama": "ask me anything", "eli5": "explain like i am five", "diy": "do it yourself", "tmi": "too much information", "bff": "best friends forever",
    "jk": "just kidding", "np": "no problem", "thx": "thanks", "ty": "thank you", "yw": "you are welcome", "pls": "please", "plz": "please", "rn": "right now", "atm": "at the moment",
    "asap": "as soon as possible", "eta": "estimated time of arrival", "goat": "greatest of all time", "fomo": "fear of missing out", "yolo": "you only live once", "tbd": "to be determined",
    "tba": "to be announced", "nsfw": "not safe for work", "sfw": "safe for work", "afk": "away from keyboard", "gtg": "got to go", "g2g": "got to go", "cya": "see you", "cu": "see you",
}
# Signs of advertising.
SPAM = (
    r"buy\s+now", r"click\s+here", r"limited\s+time\s+offer", r"act\s+now", r"free\s+(?:gift|money|trial)", r"100%\s+(?:free|guaranteed)", r"no\s+obligation", r"winner\s+(?:selected|chosen)",
    r"congratulations.*(?:won|winner)", r"urgent.*(?:action|response)", r"(?:earn|make)\s+\$?\d+.*(?:day|week|month)", r"(?:credit|debit)\s+card\s+(?:number|info)", r"(?:password|account)\s+(?:verify|confirm)",
    r"nigerian?\s+prince", r"(?:subscribe|unsubscribe)\s+(?:here|now)",
)
# Negations that stop-word removal keeps.
NEGATIONS = frozenset("not no never none nobody nothing neither nowhere cannot can't don't doesn't didn't won't wouldn't shouldn't couldn't hasn't haven't hadn't isn't aren't wasn't weren't".split())
# General English stop words, those of NLTK's public list without its forms with an apostrophe.
STOPWORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is "
    "are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now "
    "d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn".split()
)
# Labels that mean the label is missing.
UNKNOWN_LABELS = (r"^unknown$", r"^none$", r"^n/?a$", r"^\s*$", r"^unlabeled$", r"^unassigned$", r"^no\s*label$", r"^\?$")
LABEL_DELIMITERS = (",", ";", "|")
# Forms of links, mentions, hashtags, stretched letters, repeated marks, pictographs.
URL = r"""https?://[^\s<>"{}|\\^`\[\]]+|www\.[^\s<>"{}|\\^`\[\]]+|[a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z]{2,}(?:/[^\s]*)?"""
MENTION, HASHTAG, STRETCHED, MARKS = r"@[\w]+", r"#([\w]+)", r"(.)\1{2,}", r"([!?.])\1+"
EMOJI = ((0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF), (0x2702, 0x27B0), (0x24C2, 0x1F251), (0x1F900, 0x1F9FF), (0x1FA00, 0x1FAFF), (0x2600, 0x26FF))
