"""Rule packs: the word lists and patterns a text operator works with. The default pack is Korean;
a caller working in another language passes its own values in the same fields."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from tidewire.fixed import korean as ko


@dataclass(frozen=True)
class TextPack:
    script: str = ko.HANGUL
    article_patterns: list = field(default_factory=lambda: ko.ARTICLE_PATTERNS)
    article_stopwords: list = field(default_factory=lambda: ko.ARTICLE_STOPWORDS)
    token_patterns: list = field(default_factory=lambda: ko.TOKEN_PATTERNS)
    token_banned_parts: list = field(default_factory=lambda: ko.TOKEN_BANNED_PARTS)
    token_banned_endings: list = field(default_factory=lambda: ko.TOKEN_BANNED_ENDINGS)
    byline_word: str = ko.BYLINE_WORD
    body_patterns: list = field(default_factory=lambda: ko.BODY_PATTERNS)
    scope_title_patterns: list = field(default_factory=lambda: ko.SCOPE_TITLE_PATTERNS)
    credit_title_patterns: list = field(default_factory=lambda: ko.CREDIT_TITLE_PATTERNS)
    token_clean_patterns: list = field(default_factory=lambda: ko.TOKEN_CLEAN_PATTERNS)
    rule_text_patterns: list = field(default_factory=lambda: ko.RULE_TEXT_PATTERNS)
    rule_text_synonyms: list = field(default_factory=lambda: ko.RULE_TEXT_SYNONYMS)
    metric_marks: str = ko.METRIC_MARKS
    metric_stopwords: list = field(default_factory=lambda: ko.METRIC_STOPWORDS)
    metric_endings: list = field(default_factory=lambda: ko.METRIC_ENDINGS)
    top_issue_stopwords: list = field(default_factory=lambda: ko.TOP_ISSUE_STOPWORDS)
    top_issue_banned_parts: list = field(default_factory=lambda: ko.TOP_ISSUE_BANNED_PARTS)
    keyword_stopwords: list = field(
        default_factory=lambda: [
            *ko.KEYWORD_STOPWORDS_STEM, *ko.KEYWORD_STOPWORDS_ENDING, *ko.KEYWORD_STOPWORDS_CONJUNCTION,
            *ko.KEYWORD_STOPWORDS_TIME, *ko.KEYWORD_STOPWORDS_RELATION, *ko.KEYWORD_STOPWORDS_MEDIA,
            *ko.KEYWORD_STOPWORDS_URL, *ko.KEYWORD_STOPWORDS_UNIT,
        ]
    )
    keyword_short_allowed: list = field(default_factory=lambda: ko.KEYWORD_SHORT_ALLOWED)
    verb_like_ending: str = ko.VERB_LIKE_ENDING
    trim_particles: str = ko.TRIM_PARTICLES
    noise_patterns: list = field(default_factory=lambda: ko.NOISE_SENTENCE_PATTERNS)
    caption_patterns: list = field(default_factory=lambda: ko.CAPTION_SENTENCE_PATTERNS)
    meta_patterns: list = field(default_factory=lambda: ko.META_SENTENCE_PATTERNS)
    image_source_pattern: str = ko.IMAGE_SOURCE_PATTERN
    quote_patterns: list = field(default_factory=lambda: ko.QUOTE_SENTENCE_PATTERNS)
    fact_patterns: list = field(default_factory=lambda: ko.FACT_PATTERNS)
    economy_words: list = field(default_factory=lambda: ko.ECONOMY_WORDS)
    noun_stopwords: list = field(default_factory=lambda: ko.NOUN_STOPWORDS)
    roles: dict = field(
        default_factory=lambda: {
            "subject": ko.ROLE_SUBJECT, "time": ko.ROLE_TIME, "direction": ko.ROLE_DIRECTION, "issue": ko.ROLE_ISSUE,
        }
    )

    def with_values(self, **values) -> "TextPack":
        return replace(self, **values)


KOREAN = TextPack()
