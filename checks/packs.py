"""A rule pack for Latin-script text, so that the rules meet words of the given documents."""

from tidewire.functions.packs import KOREAN

LATIN = KOREAN.with_values(
    script="A-Za-zß-ÿ",
    article_patterns=[r"\([^)]*\)", r"\[[^\]]*\]", r"(by|from) [A-Z][a-z]+", r"<[^>]*>", r"[^a-zA-Zß-ÿ0-9\s]"],
    article_stopwords=["the", "of", "and", "to", "in", "is", "that", "la", "de", "der", "die"],
    token_patterns=[r"https?://\S+", r"(by|from) [a-z]{2,6}"],
    token_banned_parts=["wh"],
    token_banned_endings=["tion", "ing"],
    body_patterns=[(r"\[[^\]]{1,20}\]", " "), (r"https?://\S+", ""), (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", ""), (r"[ \n\t]{2,}", " ")],
    scope_title_patterns=[r"^\s*\[[^\]]{1,20}\]\s*", r"\[[^\]]{1,20}\]", r"\(\w+\)", r"[ \n\t]{2,}"],
    credit_title_patterns=[r"<[^>]+>", r"\([^)]*\)"],
    rule_text_patterns=[r"\[.*?\]|\(.*?\)|#.*"],
    rule_text_synonyms=[("ation", "tion"), ("and", "or"), ("or", "nor")],
    metric_stopwords=["the", "of", "and", "to", "in", "is", "that", "la", "de", "der", "die", "com", "www", "https"],
    metric_endings=["tion", "ing"],
    top_issue_stopwords=["the", "of", "and", "to", "in", "is", "that", "la", "de", "der", "die"],
    top_issue_banned_parts=["wh", "aux"],
    keyword_stopwords=["the", "of", "and", "to", "in", "is", "that", "la", "de", "der", "die", "com", "www", "https"],
    keyword_short_allowed=["re", "on", "an"],
    verb_like_ending=r"[éèê]$",
    trim_particles="aeiou",
    noise_patterns=[r"^\(", r"@\w+", r"^\d{4}"],
    caption_patterns=[r"th[.]?$"],
    meta_patterns=[r"subscribe", r"copyright"],
    image_source_pattern=r"(?:photo|image) by",
    quote_patterns=[r"^[\"']", r" was "],
    fact_patterns=[r"\d+", r"the ", r"tion "],
    economy_words=["edthe", "ing", "ment", "ung"],
    noun_stopwords=["the", "and", "with", "that", "this", "les", "des", "und", "der", "die"],
    roles={"subject": ["of", "de", "la"], "time": ["on", "en"], "direction": ["er", "re"], "issue": ["is"]},
)
