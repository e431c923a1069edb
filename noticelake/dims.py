"""Categories, interests, rule weights, academic units and display labels.

Everything in this module must stay as it is for results to agree with existing stores. Board
dimensions differ per installation, so boards are always passed in as a DataFrame (schemas.BOARD).
"""

from __future__ import annotations

# --- fixed values: enums ---------------------------------------------------------------------
CATEGORIES = ["장학금", "학사", "모집/선발", "행사/특강", "취업/진로", "국제교류", "시설/생활", "기타"]
CATEGORY_EN = {
    "장학금": "Scholarship",
    "학사": "Academic affairs",
    "모집/선발": "Recruitment",
    "행사/특강": "Events & talks",
    "취업/진로": "Careers",
    "국제교류": "International",
    "시설/생활": "Campus life",
    "기타": "Other",
}
SOURCE_KINDS = ["main", "college", "department"]
PENDING_CATEGORY = "pending"

# --- fixed values: limits and windows ----------------------------------------------------------
DEDUP_WINDOW_DAYS = 3
MIN_KEY_CHARS = 6
MIN_CONTENT_CHARS = 30
RECHECK_DAYS = 7
MAX_CONSECUTIVE_OVERLOADS = 3
FOR_YOU_LIMIT = 6
UPCOMING_DAYS = 30
UPCOMING_LIMIT = 6
NOTIFICATION_DAYS = 14
CLOSING_SOON_DAYS = 7
MAX_CHIPS = 3
EXCERPT_RADIUS = 24
PROMPT_VERSION = "v3"

# --- fixed values: match weights ---------------------------------------------------------------
SCORE = {
    "major": 50,
    "college": 30,
    "title_major": 35,
    "title_college": 20,
    "board_major": 35,
    "board_college": 20,
    "year": 25,
    "all_undergrad": 25,
    "interest_category": 30,
    "interest_keyword": 20,
}
LEVEL_HIGH = 50
LEVEL_MEDIUM = 25
MAX_SCORE = 100

# --- fixed values: interests -------------------------------------------------------------------
INTEREST_LABELS = {
    "scholarship": ("장학금", "Scholarships"),
    "competition": ("공모전·대회", "Competitions"),
    "career": ("인턴·취업", "Internships & careers"),
    "academic": ("학사·교육 프로그램", "Academic programs"),
    "event": ("행사·특강", "Events & talks"),
    "activity": ("모집·대외활동", "Recruitment & activities"),
    "international": ("국제교류", "International"),
}
# interest -> (categories, title keyword pattern)
INTEREST_RULES = {
    "scholarship": (["장학금"], "장학"),
    "competition": ([], "공모전|경진대회|대회|챌린지|해커톤|콘테스트"),
    "career": (["취업/진로"], "인턴|채용|취업|현장실습|직무|면접"),
    "academic": (["학사"], "수강|학사|계절학기|학점|다중전공|복수전공|부전공"),
    "event": (["행사/특강"], "특강|설명회|박람회|포럼|세미나|축제"),
    "activity": (["모집/선발"], "서포터즈|기자단|대외활동|멘토|봉사단"),
    "international": (["국제교류"], "교환학생|해외|파견|국제교류|어학연수"),
}

# --- fixed values: eligibility patterns --------------------------------------------------------
GRAD_WORDS = "대학원생|석사|박사"
UNDERGRAD_WORDS = "학부"
BROAD_WORDS = r"학부생|재학생|전체\s*학생|학생\s*전체|전체"
UNVERIFIABLE_WORDS = r"이수\s*중|이수자|이수예정자|취득|해당|참여자|수강생|수혜자\s*중|선정된|선발된|소지자"

# --- fixed values: academic units (college, former names, majors with other spellings) ----------
UNITS = [
    ("공과대학", [], ["기계공학과", "항공우주공학과", "조선해양공학과", "산업경영공학과", "화학공학과", "고분자공학과",
                  "신소재공학과", "사회인프라공학과", "환경공학과", "공간정보공학과", "건축공학", "건축학", "에너지자원공학과",
                  "융합기술경영학부", "전기전자공학부", "반도체시스템공학과", "이차전지융합학과"]),
    ("자연과학대학", [], ["수학과", "통계학과", "물리학과", "화학과", "해양과학과", "식품영양학과"]),
    ("경영대학", [], ["경영학과", "파이낸스경영학과", "아태물류학부", "국제통상학과"]),
    ("사범대학", [], ["국어교육과", "영어교육과", "사회교육과", "교육학과", "체육교육과", "수학교육과"]),
    ("사회과학대학", [], ["행정학과", "정치외교학과", "미디어커뮤니케이션학과", "경제학과", "소비자학과", "아동심리학과", "사회복지학과"]),
    ("문과대학", [], ["한국어문학과", "사학과", "철학과", "중국학과", "일본언어문화학과", "영미유럽인문융합학부", "문화콘텐츠문화경영학과"]),
    ("의과대학", [], ["의예과", "의학과"]),
    ("미래융합대학", [], ["메카트로닉스공학과", "소프트웨어융합공학과", "산업경영학과", "금융투자학과", "반도체산업융합학과"]),
    ("예술체육대학", [], ["조형예술학과", "디자인융합학과", "스포츠과학과", "연극영화학과", "의류디자인학과"]),
    ("국제학부", [], ["IBT학과", "ISE학과", "KLC학과"]),
    ("프런티어창의대학", [], ["자유전공융합학부", "공학융합학부", "자연과학융합학부", "경영융합학부", "사회과학융합학부", "인문융합학부"]),
    ("AI융합대학", ["소프트웨어융합대학"], ["인공지능공학과", "데이터사이언스학과", "스마트모빌리티공학과", "디자인테크놀로지학과", "컴퓨터공학과"]),
    ("간호대학", [], ["간호학과"]),
    ("바이오시스템융합학부", [], ["생명공학과", "바이오제약공학과", "생명과학과", "첨단바이오의약학과", "바이오식품공학과"]),
]
MAJOR_ALIASES = {"건축공학": ["건축학부"], "건축학": ["건축학부"], "경영학과": ["경영학부"], "파이낸스경영학과": ["경영학부"]}

# --- fixed values: display labels --------------------------------------------------------------
LABELS = {
    "ko": {
        "deadline": "신청 마감", "event": "행사 일정", "closed": "마감", "main": "본교", "source": "원문",
        "relevant": "나에게 맞는 공지", "new": "새로운 공지",
        "weekdays": ["일", "월", "화", "수", "목", "금", "토"],
        "description": "AI가 공지에서 추출한 날짜예요. 반드시 원문에서 확인하세요.",
    },
    "en": {
        "deadline": "Deadline", "event": "Event", "closed": "Closed", "main": "University", "source": "Original notice",
        "relevant": "Relevant to you", "new": "New notice",
        "weekdays": ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"],
        "months": ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"],
        "months_long": ["January", "February", "March", "April", "May", "June", "July", "August", "September",
                        "October", "November", "December"],
        "description": "Dates extracted from the notice by AI. Always confirm them in the original notice.",
    },
}


def unit_terms() -> list[tuple[str, str | None, str]]:
    """(term, major or None, college) for every name a unit may be written with."""
    terms: list[tuple[str, str | None, str]] = []
    for college, former, majors in UNITS:
        terms += [(name, None, college) for name in [college, *former]]
        terms += [(name, major, college) for major in majors for name in [major, *MAJOR_ALIASES.get(major, [])]]
    return terms


def former_colleges() -> dict[str, str]:
    return {old: college for college, former, _ in UNITS for old in former}
