"""Word lists, patterns and constants that the Korean results depend on.

Patterns are applied in the order given, with Unicode classes and Unix line ends.
"""

# --- Fixed values: constants ------------------------------------------------------------------
SIMILARITY_THRESHOLD = 0.82
ARTICLES_PER_SCOPE = 30
NEAREST_SCOPES = 3
NEAR_COPY_COSINE = 0.9
SENTENCE_COPY_COSINE = 0.85
NEUTRAL_GAP = 0.1
LEXICON_BOOST = 0.15
TITLE_BOOST = 0.3
NO_EMBEDDING = "__no_embedding__"
DEFAULT_STAY_SECONDS = 300

# --- Fixed values: article text cleaning ------------------------------------------------------
ARTICLE_STOPWORDS = [
    "은", "는", "이", "가", "을", "를", "의", "에서", "에", "와", "과", "도", "만", "기자", "뉴스", "영상", "편집",
    "앵커", "연합뉴스", "뉴시스", "한경", "한경닷컴", "게티이미지뱅크", "사진", "제공", "특파원", "포토", "이미지",
    "캡처", "닷컴", "헤럴드", "경제", "이상섭", "최혁", "정호원", "김익환", "제보",
]
ARTICLE_PATTERNS = [
    r"(YTN|KBS|SBS|MBC|JTBC|TV조선|채널A|MBN|연합뉴스TV)\s*[가-힣]{2,4}입니다\.?.*$",
    r"([가-힣]{2,4})\s?(기자|앵커|특파원|리포터|캐스터)",
    r"(영상편집|영상취재|영상기자|그래픽|촬영기자|촬영|편집|디자인|작가)\s*[:：]?\s*([가-힣]{2,4})",
    r"[가-힣]+=\s*([가-힣]{2,4})\s?(기자|특파원)",
    r"(기자|앵커|특파원)\s*([가-힣]{2,4})",
    r"(사진|제공|연합뉴스|뉴시스|한경DB|게티이미지뱅크)[=:\s]*[가-힣A-Za-z0-9· ]{0,20}",
    r"\[[가-힣]{2,4}의 [^\]]+\]",
    r"\[[^\]]+\]",
    r"(포즈|캡처|자료사진)",
    r"(YTN|KBS|SBS|MBC|JTBC|TV조선|채널A|MBN|연합뉴스TV)\s*[가-힣]{2,4}입니다\.?",
    r"※.*$",
    r"(\[?카카오톡\]?|\[?전화\]?|\[?메일\]?).*$",
    r"(영상\s*기자|영상\s*편집|영상\s*취재|촬영\s*기자|영상기자|영상편집|영상취재|촬영기자|그래픽|디자인|작가|편집|촬영)\s*[:：]?\s*[가-힣]{2,4}",
    r"<[^>]*>",
    r"[^가-힣a-zA-Z0-9\s]",
]

# --- Fixed values: byline and credit removal before tokenising --------------------------------
TOKEN_PATTERNS = [
    r"[가-힣]{2,4}\s?(기자|앵커|특파원|리포터|캐스터)",
    r"(기자|앵커|특파원|리포터|캐스터)\s?[가-힣]{2,4}",
    r"(촬영기자|영상취재|영상편집|영상기자|자료조사|그래픽|디자인|촬영|영상|작가|편집|사진|자막|CG)\s*[:：]?\s*[가-힣]{2,4}",
    r"(영상\s*편집|영상\s*취재|영상\s*기자|촬영\s*기자)\s*[:：]?\s*[가-힣]{2,4}",
    r"(영상\s*기자|영상\s*편집|영상\s*취재|촬영\s*기자|그래픽|디자인|작가|편집|촬영)\s*[:：]?\s*[가-힣]{2,4}",
    r"(YTN|KBS|SBS|MBC|JTBC|TV조선|채널A|MBN|연합뉴스TV)\s*[가-힣]{2,4}입니다\.?",
    r"[가-힣]{2,4}\s+(영상\s*편집|영상\s*취재|영상\s*기자|촬영\s*기자|그래픽|디자인|작가|편집|촬영)\s*[:：]?\s*[가-힣]{2,4}.*$",
    r"※?\s*['\"‘’“”]?\s*당신의\s*제보가\s*뉴스가\s*됩니다.*$",
]
TOKEN_BANNED_PARTS = ["기자", "특파원"]
TOKEN_BANNED_ENDINGS = ["세요", "시오", "합니다", "했다", "된다", "됐다", "니다"]
BYLINE_WORD = "기자"

# --- Fixed values: body cleaning for issue summaries (pattern, replacement) --------------------
BODY_PATTERNS = [
    (r"^\s*\[[^\]]{1,20}\]\s*", ""),
    (r"\[[^\]]{1,20}\]", " "),
    (r"(?s)\[앵커\].+?(?=\[리포트\])", ""),
    (r"(?s)\[앵커\].+", ""),
    (r"\[리포트\]\s*", ""),
    (r"(?s)【\s*앵커멘트\s*】.+?(?=【)", ""),
    (r"(?s)【\s*앵커멘트\s*】.+", ""),
    (r"【[^】]{1,20}】\s*", ""),
    (r"(?s)◀\s*앵커\s*▶.+?(?=◀\s*(?:리포트|기자)\s*▶)", ""),
    (r"(?s)◀\s*앵커\s*▶.+", ""),
    (r"◀\s*(?:리포트|기자|END)\s*▶\s*", ""),
    (r"\[[가-힣\s/·]{2,30}\s*:\s*", ""),
    (r"\([^)]{1,20}=[^)]{1,20}\)\s*[가-힣\s]{2,10}기자\s*=?\s*", ""),
    (r"[가-힣]{2,4}[·]?[가-힣]{0,4}\s*기자\s*=?\s*", ""),
    (r"ⓒ\s*[^\s,]{1,20}", ""),
    (r"\d{4}[.\-]\d{1,2}[.\-]\d{1,2}", ""),
    (r"무단\s*전재[^.]*재배포\s*금지[^.]*\.?", ""),
    (r"저작권자[^.]*\.?", ""),
    (r"(?i)All rights reserved[^.]*\.?", ""),
    (r"\([^)]{1,30}=[^)]{1,30}\)", ""),
    (r"\((?:REUTERS|AP|AFP|EPA|Getty)[^)]*\)", ""),
    (r"이미지\s*확대\s*", ""),
    (r"사진은\s*기사와\s*관련\s*없음", ""),
    (r"/?\s*사진=게티이미지[^\s/]*", ""),
    (r"/?\s*사진=[^\s/]{1,30}", ""),
    (r"이\s*기사는?\s*\d{4}년.+?(?:선공개|공개)\s*되었습니다[.。]?", ""),
    (r"이\s*기사는?\s*.{1,30}(?:프리미엄|유료)\s*콘텐츠.+?[.。]", ""),
    (r"(?:프리미엄|유료)\s*콘텐츠로?\s*선공개.+?[.。]", ""),
    (r"구독자\s*전용.+?[.。]", ""),
    (r"유료\s*기사입니다.+?[.。]", ""),
    (r"관련\s*기사\s*\d+건[^.]*\.?", ""),
    (r"\d+건을?\s*분석한\s*결과[^.]*\.?", ""),
    (r"이\s*기사[는은]\s*AI[^.]*\.?", ""),
    (r"AI\s*(가|이|로)\s*[^.]{1,30}(작성|생성|요약)[^.]*\.?", ""),
    (r"^\s*\((?:종합\d*|상보|속보|\d+보)\)\s*", ""),
    (r"\((?:종합\d*|상보|속보|\d+보)\)", ""),
    (r"\[[가-힣a-zA-Z\s]+\s+[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\]", ""),
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", ""),
    (r"구독중?\s*", ""),
    (r"이전\s+다음", ""),
    (r"(?s)관련\s*뉴스.+", ""),
    (r"https?://\S+", ""),
    (r"@[가-힣a-zA-Z0-9_]{2,20}", ""),
    (r"(?s)이메일\s*:\s*.+", ""),
    (r"카카오톡\s*:\s*\S+", ""),
    (r"사이트\s*:\s*\S+", ""),
    (r"유튜브\s*:\s*\S+", ""),
    (r"텔레그램\s*:\s*\S+", ""),
    (r"인스타그램\s*:\s*\S+", ""),
    (r"\d{2,4}[-\s]?\d{3,4}[-\s]?\d{4}", ""),
    (r"(?s)구독하기.+", ""),
    (r"(?s)뉴스레터.+", ""),
    (r"(?s)더\s*많은\s*뉴스.+", ""),
    (r"(?s)자세한\s*내용은.+", ""),
    (r"(?s)▶.+", ""),
    (r"(?s)☞.+", ""),
    (r"(?s)※.+", ""),
    (r"[^.!?]{5,60}(?:하는|된|찍은|촬영한|모인|참석한)\s*모습[.。]?", ""),
    (r"[^.!?]{5,60}(?:장면|광경)[.。]?", ""),
    (r"[^.!?]{5,60}모습이다[.。]?", ""),
    (r"\d{1,2}일\s+[가-힣]{2,10}(?:이|가|은|는)\s+[^.]{5,50}모습[.。]?", ""),
    (r"(?:그래픽|디자인|영상취재|영상촬영|영상기자|촬영기자|영상편집|작가)[^.!?\n]{0,50}", ""),
    (r"\s{2,}", " "),
]

# --- Fixed values: title cleaning ---------------------------------------------------------------
SCOPE_TITLE_PATTERNS = [
    r"^\s*\[[^\]]{1,20}\]\s*",
    r"\[[^\]]{1,20}\]",
    r"\((?:종합\d*|상보|속보|\d+보)\)",
    r"^[가-힣a-zA-Z\s·]{2,15}\s*[|｜]\s*",
    r"\s{2,}",
]
CREDIT_TITLE_PATTERNS = [
    r"<[^>]+>",
    r"\([^)]*(?:취재|편집|디자인|촬영|제작)\s*:\s*[^)]*\)",
]

# --- Fixed values: token cleaning ---------------------------------------------------------------
TOKEN_CLEAN_PATTERNS = [
    r"https?://\S+",
    r"ftp://\S+",
    r"www\.\S+",
    r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}",
    r"\b[a-zA-Z0-9-]+\.[a-zA-Z]{2,6}\b",
    r"\b[\d,.\-]+\b",
    r"[^\w\s가-힣]",
]

# --- Fixed values: rule-text normalisation ------------------------------------------------------
RULE_TEXT_PATTERNS = [r"\[.*?\]|\(.*?\)|=연합뉴스|기자|뉴스|#.*", r"성과급\w*"]
RULE_TEXT_SYNONYMS = [
    ("불황", "침체"), ("경기악화", "침체"), ("마이너스 성장", "침체"),
    ("호조", "상승"), ("해외", "글로벌"), ("외국", "글로벌"), ("미국", "글로벌"), ("중동", "글로벌"),
    ("예측", "전망"), ("관측", "전망"), ("내다봤", "전망"), ("추산", "전망"),
]

# --- Fixed values: daily keyword metrics --------------------------------------------------------
METRIC_MARKS = "#\"'“”‘’…·.,?!"
METRIC_STOPWORDS = [
    "com", "co", "kr", "www", "http", "https", "db", "photo", "newsis", "yna", "yonhap", "graphics", "graphic",
    "그래픽", "사진", "기자", "제공", "금지", "관련", "종합", "단독", "속보", "뉴스", "보도", "기사", "무단", "전재",
    "재배포", "습니다", "합니다", "했습니다", "있습니다", "없습니다", "됩니다", "됐습니다",
    "일제히", "본격적인", "굳어지", "손본다",
]
METRIC_ENDINGS = [
    "습니다", "합니다", "했습니다", "됩니다", "됐습니다", "있습니다", "없습니다", "한다고", "했다고", "된다", "됐다",
    "한다", "했다", "있다", "없다", "하다", "되다",
]

# --- Fixed values: daily top issue --------------------------------------------------------------
TOP_ISSUE_STOPWORDS = [
    "관계자", "관계인", "기자", "뉴스", "기사", "기사문", "보도자료", "뉴시스", "연합뉴스", "뉴스1", "tv", "그래픽",
    "게시판", "헤드라인", "리포트", "브리핑", "경영진",
    "오늘", "내일", "어제", "올해", "내년", "지난해", "지난달", "최근", "하루", "시간", "이날", "이번", "지난",
    "그동안", "당시", "현재", "향후", "다음", "먼저",
    "경우", "때문", "정도", "우리", "이들", "통해", "대해", "위해", "관련", "가운데", "상황", "모두", "일부", "수준",
    "부분", "가능성", "전망", "분위기",
    "정부", "국회", "기업", "업계", "시장", "경제", "금융", "경기", "경쟁력", "글로벌", "성장", "투자", "지원",
    "서비스", "브랜드", "데이터", "시스템", "사업", "산업", "소비", "고객", "대상자", "구성원", "임직원",
    "공무원", "대통령", "위원장", "위원회", "감독원", "금감원", "거래소", "국토부", "산업부", "중기부", "공정위",
    "확대", "강화", "추진", "진행", "개최", "발표", "확인", "검토", "제기", "밝히", "나오", "따르", "전하", "이어지",
    "올리", "내리", "들어가", "가져오", "기다리",
]
TOP_ISSUE_BANNED_PARTS = ["관계자", "기자", "정부", "업계", "기업", "위원", "감독원"]

# --- Fixed values: article keyword validity -----------------------------------------------------
KEYWORD_STOPWORDS_STEM = [
    "있", "하", "되", "이", "없", "않", "같", "위", "말", "보", "오", "가", "나", "받", "통", "되다", "하다", "이다",
    "기다리", "가져오", "내다보", "갈아타", "가라앉", "가리키", "내려가", "내려오", "나아가", "만든다", "뚫었다",
    "몰렸다", "올랐다", "늘었다", "키운다",
]
KEYWORD_STOPWORDS_ENDING = [
    "있다", "없다", "한다", "된다", "됩니다", "합니다", "입니다", "됐다", "했다", "였다", "있습니다", "없습니다",
    "않다", "같다", "크다", "작다", "많다", "적다", "높다", "낮다", "좋다", "나쁘다", "는데", "는데요", "지만",
    "으며", "이며", "거나", "든지", "이고", "하고", "으로서", "로서", "밝혔다", "말했다", "전했다", "설명했다",
    "강조했다", "덧붙였다", "지적했다", "밝혀졌다", "알려졌다", "나타났다", "드러났다",
]
KEYWORD_STOPWORDS_CONJUNCTION = [
    "그리고", "그러나", "그런데", "그래서", "또한", "하지만", "따라서", "왜냐하면", "그러므로", "결국", "즉", "또",
    "및", "더욱", "더욱이", "오히려", "특히", "다만", "단지",
]
KEYWORD_STOPWORDS_TIME = [
    "이번", "지난", "최근", "오늘", "내일", "어제", "현재", "올해", "지금", "당시", "이후", "이전", "앞서", "이날",
    "오는", "올초", "연초", "연말", "상반기", "하반기", "지난달", "지난해", "그동안", "마지막", "마무리", "거래일",
    "이번엔",
]
KEYWORD_STOPWORDS_RELATION = [
    "대한", "관련", "통해", "위해", "따른", "위한", "관한", "의한", "바탕", "가운데", "경우", "것으로", "것이다",
    "때문", "통한", "위하여", "대해", "따라", "해당", "일부", "모두", "전체", "각각", "일정", "다양", "글로벌",
    "경쟁력", "성장", "본격화", "정상화", "활성화", "장기화", "대규모", "안정적", "가능성", "불확실성", "역대급",
    "이벤트", "캠페인", "맞춤형", "차세대",
]
KEYWORD_STOPWORDS_MEDIA = [
    "기자", "뉴스", "기사", "보도", "사진", "제공", "출처", "무단", "전재", "재배포", "금지", "저작권", "연합뉴스",
    "취재", "인터뷰", "copyright", "reserved", "rights", "ⓒ", "all", "관계자", "뉴시스", "그래픽", "기사문",
    "게티이미지뱅크", "데일리안", "올댓차이나", "로이터", "연합뉴스tv", "간담회", "기념사진", "갈무리",
]
KEYWORD_STOPWORDS_URL = ["www", "com", "co", "kr", "net", "org", "http", "https", "html", "php", "asp", "jsp"]
KEYWORD_STOPWORDS_UNIT = ["억원", "만원", "조원", "달러", "유로", "퍼센트", "위안", "엔화", "파운드"]
KEYWORD_SHORT_ALLOWED = [
    "금리", "주가", "환율", "채권", "주식", "물가", "코스피", "코스닥", "나스닥", "다우", "기업", "은행", "정부",
    "국회", "법원", "청와대", "반도체", "배터리", "바이오", "부동산", "원자재", "수출", "수입", "투자", "융자",
    "금융", "재정", "예산", "세금", "세율", "적자", "흑자", "성장", "침체", "경기", "임금", "고용", "실업", "소비",
    "생산", "무역",
]
VERB_LIKE_ENDING = r"[하되이아어고며서지않받줄쓸올갈낼살볼]$"

# --- Fixed values: sentences --------------------------------------------------------------------
TRIM_PARTICLES = "다며서고은는이가을를에의"
NOISE_SENTENCE_PATTERNS = [
    r"^\(.*?사진.*?\)", r"^사진\s*[=:]", r"※.*?금지", r"^\[.*?\]", r"^[가-힣]{1,4}\s*기자", r"@\w+",
    r"^\d{4}\.\s*\d{1,2}", r"무단\s*전재",
]
CAPTION_SENTENCE_PATTERNS = [
    r"(?:하는|된|찍은|모인|참석한)\s*모습[.。]?\s*$", r"(?:장면|광경)[.。]?\s*$", r"모습이다[.。]?\s*$",
    r"\d{1,2}일\s+[가-힣]{2,10}(?:이|가)\s+[^.]{5,40}모습",
]
META_SENTENCE_PATTERNS = [
    r"이\s*기사는?\s*\d{4}년", r"프리미엄\s*콘텐츠", r"선공개\s*되었", r"구독자\s*전용", r"유료\s*기사",
    r"본\s*기사는?\s*.{1,30}제공",
]
IMAGE_SOURCE_PATTERN = r"(?:\[|\()?[가-힣a-zA-Z\s]{2,20}(?:홈페이지|캡처|제공|촬영|AFP|AP|EPA|로이터)[.\])]?"
QUOTE_SENTENCE_PATTERNS = [
    r"익명", r"한\s*전문가", r"관계자[는은]\s*", r"당국자[는은]\s*",
    r"[가-힣]{2,4}\s*(?:장관|의원|대표|대통령|총리|장|회장|사장|이사)[는은이가]\s*[\"']", r"^[\"']",
    r"라고\s*(?:말했|밝혔|전했|했)", r"라며\s*", r"고\s*(?:말했|밝혔|전했|했)",
]
FACT_PATTERNS = [
    r"\d+[\.,]?\d*\s*(?:%|퍼센트|배|조|억|만|천|달러|원|위안|엔)",
    r"역대|최초|처음|사상|최대|최소|최고|최저|신기록",
    r"전년\s*(?:대비|동기|동월)", r"전월\s*(?:대비|대비)",
    r"(?:증가|감소|상승|하락|급등|급락|돌파|하회|상회)\s*(?:했|했다|했으며|했고)",
]
ECONOMY_WORDS = [
    "은행", "증권", "금융", "보험", "투자", "펀드", "자산", "기업", "회사", "법인", "계열사", "자회사", "지주", "인수",
    "합병", "매각", "계약", "협약", "협력", "제휴", "상장", "공모", "IPO", "유상증자", "금리", "환율", "물가", "GDP",
    "성장률", "실업률", "수출", "수입", "무역", "관세", "경상수지", "주가", "코스피", "코스닥", "증시", "시가총액",
    "매출", "영업이익", "순이익", "실적", "분기", "연간", "부동산", "집값", "전세", "아파트", "분양", "세금", "세율",
    "과세", "감세", "세제", "절세", "규제", "완화", "정책", "예산", "재정", "국채", "금통위", "한국은행", "연준",
    "기재부", "금감원",
]
HANGUL = "가-힣"

# --- Fixed values: issue titles -----------------------------------------------------------------
NOUN_STOPWORDS = [
    "관련", "문제", "상황", "내용", "부분", "경우", "방안", "계획", "이후", "현재", "최근", "지난", "올해", "이번",
    "해당", "오늘", "어제", "지금", "당시", "발표", "보도", "뉴스", "기자", "기사", "취재", "종합", "단독", "속보",
    "업데이트", "기록", "수준", "규모", "이상", "이하", "대비", "대상", "기준", "분석", "이슈", "스퀘어", "넘버스",
    "특집", "기획", "동향", "전망", "현황", "정리", "요약", "심층", "집중", "미디어", "채널", "방송", "라이브",
    "온라인", "결과", "영향", "효과", "변화", "추이", "흐름", "움직임", "가운데", "속에서", "상황에서", "따라서",
    "최고", "최저", "사상", "역대", "전쟁", "행진", "충격", "위기", "공포", "우려", "기대", "가능성", "여부", "논의",
    "대응", "추진", "검토", "예정", "시작", "완료", "한국", "우리", "국내", "국외", "해외", "글로벌", "세계", "지갑",
    "주머니", "살림", "형편", "부담", "압박", "타격", "전문가", "관계자", "당국", "업계", "시장", "소비자", "국민",
]
ROLE_SUBJECT = [
    "한국은행", "금융위", "금감원", "기재부", "국토부", "산업부", "공정위", "국세청", "관세청", "청와대", "국회",
    "정부", "대통령", "삼성", "삼성전자", "현대차", "기아", "SK", "LG", "롯데", "포스코", "카카오", "네이버",
    "하이닉스", "셀트리온", "삼천당제약", "쿠팡", "연준", "Fed", "ECB", "IMF", "트럼프", "바이든", "시진핑", "미국",
    "중국", "일본", "유럽", "러시아", "중동", "애플", "엔비디아", "테슬라", "BYD",
]
ROLE_TIME = [
    "분기", "전년", "역대", "최대", "최저", "최고", "사상", "연간", "월간", "주간", "상반기", "하반기", "연초", "연말",
]
ROLE_ISSUE = [
    "금리", "기준금리", "물가", "인플레이션", "환율", "달러", "수출", "수입", "무역", "무역수지", "관세", "무역전쟁",
    "주가", "코스피", "코스닥", "증시", "주식", "부동산", "집값", "전세", "아파트", "반도체", "배터리", "전기차",
    "바이오", "매출", "영업익", "영업이익", "순이익", "실적", "고용", "실업", "취업", "일자리", "유가", "원유",
    "에너지", "양도세", "법인세", "소득세", "세금", "절세", "예금", "적금", "대출", "채권", "펀드", "ETF", "논란",
    "의혹", "해명", "리스크",
]
ROLE_DIRECTION = [
    "증가", "감소", "상승", "하락", "급등", "급락", "인상", "인하", "동결", "확대", "축소", "둔화", "흑자", "적자",
    "회복", "침체", "위기", "호조", "부진", "돌파", "급증", "급감", "반등", "폭등", "폭락",
]
DEFAULT_SCOPE_TITLE = "주요 경제 이슈"
POOR_SUMMARY = "요약 품질이 충분치 않아 원문을 통해 내용 확인"

# --- Fixed values: labels -----------------------------------------------------------------------
SENTIMENT_NAMES = {"positive": "긍정", "neutral": "중립", "negative": "부정"}
ROLE_NAMES = {"일반": "general", "관리자": "admin", "최고관리자": "superadmin"}
UNCLASSIFIED = ["관점 미분류", "미분류", "관점 정보 없음"]
FALLBACK_VIEWPOINT = "단순 전달"
UNCLASSIFIED_VIEWPOINT = "미분류"
VIEWPOINT_GROUPS = {
    "책임 소재": ["정부 책임", "기업 책임", "개인 책임", "외부 책임", "복합 책임"],
    "태도 및 감성": ["비판적 태도", "우려", "기대", "성과 예찬"],
    "정보 전달 및 분석": ["단순 전달", "원인 분석", "결과 분석", "대응 분석", "전망 분석"],
    "정책 개입": ["정부 개입 강조", "시장 자율 강조"],
    "환경 요인": ["외부 요인(글로벌)", "정책 요인(국내)"],
}
ISSUE_CHIP_STOPWORDS = [
    "기자", "뉴스", "관련", "오늘", "co", "kr", "니다", "습니다",
    "은", "는", "이", "가", "을", "를", "에", "의", "및", "등", "속", "후",
]
STAGE_ERROR_CODES = {
    "timeout": "E001", "request": "E002", "sentiment": "E004", "viewpoint": "E005", "keyword": "E006",
    "summary": "E007", "store": "E008",
}
OTHER_ERROR = "E999"
OPINION_SENTENCES = {
    ("positive", "neutral"): "%s 이슈는 긍정적 기대와 우호적 평가가 가장 많이 나타나며, 중립적 전달도 함께 확인됩니다.",
    ("positive", "negative"): "%s 이슈는 긍정적 기대와 우호적 평가가 가장 많이 나타나며, 일부 우려의 시각도 함께 확인됩니다.",
    ("positive", None): "%s 이슈는 긍정적 기대와 우호적 평가가 뚜렷하게 나타납니다.",
    ("negative", "neutral"): "%s 이슈는 우려와 비판적 해석이 가장 많이 나타나며, 중립적 전달도 함께 확인됩니다.",
    ("negative", "positive"): "%s 이슈는 우려와 비판적 해석이 가장 많이 나타나며, 일부 긍정적 기대도 함께 확인됩니다.",
    ("negative", None): "%s 이슈는 우려와 비판적 해석이 뚜렷하게 나타납니다.",
    ("neutral", "positive"): "%s 이슈는 사실 전달 중심의 중립적 보도가 가장 많이 나타나며, 긍정적 기대를 담은 해석도 일부 확인됩니다.",
    ("neutral", "negative"): "%s 이슈는 사실 전달 중심의 중립적 보도가 가장 많이 나타나며, 부정적 우려를 담은 해석도 일부 확인됩니다.",
    ("neutral", None): "%s 이슈는 사실 전달 중심의 중립적 보도가 우세하게 나타납니다.",
}
DEFAULT_TOPIC = "해당 이슈"
BINARY_TRUE_LABELS = [
    "1", "true", "o", "yes", "positive", "government", "government_responsibility", "government responsibility",
    "정부 책임", "정부책임",
]
BINARY_FALSE_LABELS = ["0", "false", "x", "no", "negative", "non_government", "not_government_responsibility"]
