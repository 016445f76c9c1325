"""Fixed values of the data model: word lists, limits and tables that results depend on."""

from __future__ import annotations

# --- fixed values: segment shaping (milliseconds) ---
TURN_GAP_MS = 800
MAX_TURN_MS = 28_000
UTTERANCE_GAP_MS = 8_000
MIN_SPEECH_MS = 300
# --- fixed values: phrases and scripts that mark recognised text as garbage ---
GARBAGE_PHRASES = ("이곳은 한국", "공공기관", "구독", "시청해주셔", "MBC", "KBS 뉴스")
FOREIGN_SCRIPT = "[Ͱ-ϿЀ-ӿ؀-ۿ぀-ヿ一-鿿]"
# --- fixed values: labels of roles ---
ROLE_LABELS = {"doctor": "의사", "patient": "환자", "guardian": "보호자", "unknown": "화자"}
# --- fixed values: numerals ---
DIGITS = {"영": 0, "일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "륙": 6, "칠": 7, "팔": 8, "구": 9}
UNITS = {"십": 10, "백": 100, "천": 1000}
BIG_UNIT = {"만": 10000}
UNIT_WORDS = ("밀리그램", "mg", "그램", "밀리리터", "ml", "cc", "리터", "mmhg", "알", "정", "캡슐", "회", "번")
# --- fixed values: medication names ---
MEDICATIONS = (
    "리시노프릴", "아스피린", "메트포르민", "암로디핀", "아토르바스타틴",
    "와파린", "오메프라졸", "아목시실린", "클로피도그렐", "심바스타틴",
    "로사르탄", "푸로세미드", "메트로니다졸", "아세트아미노펜", "이부프로펜",
)
MIN_SIMILARITY = 0.6
WINDOWS = (1, 2)
# --- fixed values: patterns of the rule engine ---
RULES_KO = {
    "dose_unit": "밀리그램|mg|(?<!킬로)그램",
    "medication": "약",
    "medication_action": "끊|중단|시작|드시|복용",
    "question": r"(나요|까요|습니까)\s*[?？]?\s*$|\?\s*$",
    "exam_order": "들어보세요|해보세요|보여주세요|해보실까요",
    "explicit_score": r"(NIHSS|mRS|MRC).{0,12}\d+\s*점",
    "diagnosis": "진단은",
    "vital": "(혈압|체중|체온|맥박|혈당)",
    "stop": "끊|중단",
    "negated_stop": r"(끊지|중단하지|멈추지)\s*(마세요|말고|말아)",
    "start": "시작",
    "symptom": r"증상|아프|힘들|못\s*자|저리|어지럽",
    "nocturnal": r"잠꼬대|소리를\s*지르|팔다리를\s*휘|발로\s*차|몸부림",
    "directive": "하겠습니다|하시고|오세요|가셔야",
    "negation": "안 |않|못",
}
# --- fixed values: workflow ---
TRANSITIONS = (
    ("DRAFT", "SUBMITTED"),
    ("SUBMITTED", "PROCESSING"),
    ("PROCESSING", "REVIEW_REQUIRED"),
    ("PROCESSING", "PROCESSING_FAILED"),
    ("REVIEW_REQUIRED", "APPROVED"),
    ("APPROVED", "PUBLISHED"),
    ("APPROVED", "REVIEW_REQUIRED"),
    ("PUBLISHED", "REVOKED"),
    ("PROCESSING_FAILED", "PROCESSING"),
)
#: The status that an encounter is created with.
INITIAL = ("DRAFT",)
EXPLANATION_FIELDS = (
    "current_situation", "tests_and_reasons", "treatment_plan", "medication_instructions",
    "warning_signs", "what_to_do_next", "follow_up", "items_to_confirm_with_clinician",
)
# --- fixed values: scoring ---
COLLAR_MS, FRAME_MS, EXACT_SPEAKERS = 250, 10, 15
DOCTOR_THRESHOLD, MIN_SHARE, MIN_EMBED_MS = 0.5, 0.1, 1000
ENROLL_WINDOW_MS, MIN_WINDOW_MS = 10_000, 2_000
SPEEDUP = 1.3
MAX_UPLOAD_BYTES, MAX_AUDIO_SECONDS = 25 * 1024 * 1024, 30 * 60
# --- fixed values: error codes with HTTP status and whether a retry may help ---
ERRORS = (
    ("STATE_TRANSITION_INVALID", 409, False),
    ("APPROVAL_STALE_VERSION", 409, False),
    ("PUBLISH_NOT_APPROVED", 409, False),
    ("VALIDATION_UNSUPPORTED_CLAIM", 422, False),
    ("NOT_FOUND", 404, False),
    ("AUDIO_FILE_TOO_LARGE", 413, False),
    ("AUDIO_DURATION_TOO_LONG", 422, False),
    ("AUDIO_UNSUPPORTED_FORMAT", 422, False),
    ("AUDIO_STREAM_MISSING", 422, False),
    ("AUDIO_PROBE_FAILED", 422, False),
    ("AUDIO_CONVERSION_FAILED", 422, True),
    ("ASR_NOT_CONFIGURED", 422, False),
    ("ASR_PROVIDER_FAILED", 502, True),
    ("LLM_NOT_CONFIGURED", 422, False),
    ("LLM_PROVIDER_FAILED", 502, True),
)
# --- fixed values: words of a violation that tell of a score or a diagnosis without a source ---
UNGROUNDED_KEYWORDS = ("score_candidates", "no doctor-sourced span")
# --- fixed values: the question and the reason of a diagnosis that no doctor stated ---
DEMOTED_QUESTION = "환자/보호자 진술만으로는 진단을 확정할 수 없습니다. 의료진 확인이 필요합니다: "
DEMOTED_RATIONALE = "원래 diagnosis로 분류되었으나 의사가 명시한 근거가 없어 강등됨"
# --- fixed values: notice of a draft ---
DRAFT_NOTICE = "의료진 검토 전 초안입니다."
# --- fixed values: what the checks of findings say ---
SPAN_DROPPED = "ungrounded source_span dropped (quote not in segment text)"
FINDING_DROPPED = "dropped entirely (no grounded source_span)"
STOP_DOWNGRADED = "source negates stopping but action=stop -- downgraded to unknown"
SCORE_CLEARED = "score_candidates without a verbatim number in source -- cleared"
VALUE_CLEARED = "value_candidates without a verbatim number in source -- cleared"
DIAGNOSIS_MOVED = "no doctor-sourced span -- moved to follow_up_questions, not a diagnosis"
