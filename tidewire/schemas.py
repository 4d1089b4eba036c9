"""Column sets of the tables the operators read and write. Missing values are NULL everywhere."""

from pyspark.sql import types as T

_s, _l, _i, _d, _b, _t = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _table(**columns):
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


PERSPECTIVE = T.ArrayType(_table(rank=_i, category=_s, score=_d))

RAW_ARTICLES = _table(
    raw_id=_s, article_id=_s, source=_s, press=_s, author=_s, url=_s, title=_s, raw_text=_s, raw_html=_s,
    error_message=_s, published_at=_t, collected_at=_t, status=_s,
)
ARTICLES = _table(
    article_id=_s, press=_s, url=_s, scope_id=_s, sentiment=_s, sentiment_score=_d, title=_s, content=_s,
    clean_text=_s, summary=_s, published_at=_t, collected_at=_t, keywords=_s, tokens=T.ArrayType(_s),
    embedding=T.ArrayType(T.FloatType()), perspective=PERSPECTIVE, is_disabled=_b, disabled_at=_t,
    like_count=_i, hate_count=_i, has_embedding=_b,
)
SCOPES = _table(
    scope_id=_s, scope_title=_s, scope_keywords=_s, scope_summary=_s, centroid=T.ArrayType(T.FloatType()),
    news_count=_l, sentiment_score=_d, sentiment_dist=_table(positive=_d, negative=_d, neutral=_d),
    created_at=_t, updated_at=_t,
)
SCOPE_QUEUE = _table(scope_id=_s, status=_s, reason=_s, queued_at=_t, processed_at=_t, retry_count=_i)
DAILY_KEYWORD_METRICS = _table(date=T.DateType(), keyword=_s, article_count=_l)
DAILY_TOP_ISSUE = _table(
    date=T.DateType(), top_keyword=_s, total_mentions=_l, positive_ratio=_d, negative_ratio=_d, neutral_ratio=_d,
)
STOPWORDS = _table(word=_s, reason=_s, added_at=_t)
VIEWPOINT_MASTER = _table(
    group_name=_s, display_title=_s, es_category=_s, icon=_s, color_key=_s, sort_order=_i,
    analysis_title=_s, analysis_desc=_s,
)
USERS = _table(user_id=_s, name=_s, role=_s, gender=_s, birth_date=T.DateType(), created_at=_t)
LOGIN_LOGS = _table(user_id=_s, event_type=_s, result=_s, fail_count_at_time=_i, created_at=_t)
ARTICLE_VIEWS = _table(user_id=_s, article_id=_s, is_valid_view=_b, created_at=_t)
ARTICLE_REACTIONS = _table(user_id=_s, article_id=_s, reaction_type=_s, created_at=_t)
ARTICLE_META = _table(article_id=_s, created_at=_t)
BATCH_JOBS = _table(job_id=_l, code_id=_s, start_at=_t, end_at=_t, total_count=_l, fail_count=_l)
PROCESS_LOGS = _table(history_id=_l, job_id=_l, code_id=_s, article_id=_s, status=_s, occurred_at=_t)
ERROR_LOGS = _table(history_id=_l, error_code=_s, error_message=_s)
PIPELINE_ERRORS = _table(history_id=_l, error_code=_s, error_message=_s, article_id=_s, scope_id=_s, occurred_at=_t)
LEXICON = _table(keyword=_s, sentiment=_s, weight=_d, source=_s, uploaded_at=_t)
CORRECTIONS = _table(
    id=_l, article_id=_s, original_sentiment=_s, original_score=_d, corrected_sentiment=_s, corrected_by=_s,
    memo=_s, used_in_finetune=_i, created_at=_t,
)
BANNERS = _table(
    banner_id=_l, banner_type=_s, title=_s, landing_url=_s, image_url=_s, content=_s, is_pinned=_b,
    start_at=T.DateType(), end_at=T.DateType(), is_active=_b, created_at=_t,
)
ADMIN_LOGS = _table(log_id=_l, admin_id=_s, action_code=_s, action_detail=_s, created_at=_t)
