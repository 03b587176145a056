"""All registered queries by name."""

from duckcheck.case import Case
from duckcheck.count_cases import CASES as COUNTS
from duckcheck.log_cases import CASES as LOGS
from duckcheck.people_cases import CASES as PEOPLE
from duckcheck.quality_cases import CASES as CHECKS
from duckcheck.question_cases import CASES as QUESTIONS
from duckcheck.report_cases import CASES as REPORTS
from duckcheck.store_cases import CASES as STORES
from duckcheck.stream_cases import CASES as STREAMS
from duckcheck.text_cases import CASES as TEXTS

CASES: dict[str, Case] = {**REPORTS, **PEOPLE, **TEXTS, **LOGS, **QUESTIONS, **STORES, **COUNTS, **CHECKS, **STREAMS}
