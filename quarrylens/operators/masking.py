"""Personal-data detection over column metadata, and masking as a projection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.names import mask_email_sql, mask_sql, quoted
from quarrylens.functions.text import mask, mask_email

@dataclass(frozen=True)
class Kind:
    """A kind of personal data: words in a logical name or comment, a pattern of column names, kept signs at both ends, and what it is not."""

    id: str
    words: tuple[str, ...]
    columns: str
    head: int
    tail: int
    not_ending: tuple[str, ...] = ()
    not_containing: tuple[str, ...] = ()
    not_columns: str = ""


#: Endings and column names that no personal value has, and the kinds in order of precedence.
NEVER_ENDINGS = ("여부", "코드", "구분", "유형", "종류", "건수", "횟수", "내용", "제목", "순번", "상태")
NEVER_COLUMNS = r"_(?:YN|AT|CD|CODE|SE|TY|TYPE|CNT|CO|CN|SJ|SN|STTUS)$"
KINDS = (
    Kind("rrn", ("주민등록번호", "주민번호", "외국인등록번호"), r"(?:^|_)(?:IHIDNUM|JUMIN|JUMIN_?NO|RRN|RESIDENT_?NO|FRGNR_?NO)(?:_|$)", 6, 0),
    Kind(
        "phone", ("전화번호", "휴대폰", "휴대전화", "이동전화", "핸드폰", "팩스번호", "연락처"),
        r"(?:^|_)(?:[A-Z]*TELNO|MBTLNUM|FXNUM|PHONE[A-Z]*|MOBILE[A-Z]*|FAX[A-Z]*|HP_?NO|CELL_?NO)(?:_|$)", 0, 4,
    ),
    Kind("email", ("이메일", "전자우편", "메일주소"), r"(?:^|_)(?:EMAIL[A-Z]*|E_MAIL|MAIL_?ADRES|MAIL_?ADDR)(?:_|$)", 2, 0),
    Kind(
        "name", ("성명", "이름", "사용자명", "회원명", "직원명", "사원명", "고객명", "신청자명", "작성자명", "등록자명", "담당자명", "수신자명", "발신자명", "대표자명"),
        r"^(?:USER|MBER|MEMBER|EMPLYR|EMP|CUST|CUSTOMER|FIRST|LAST|FULL|APPLCNT|WRTER|RGSTR)_?(?:NM|NAME)$", 1, 0,
        not_ending=("부서명", "기관명", "조직명", "파일명", "파일이름", "코드명", "업체명", "회사명", "프로그램명", "메뉴명", "시스템명", "테이블명", "컬럼명", "서버명", "게시판명", "그룹명", "권한명", "사업명", "상품명", "단체명", "직위명", "직급명", "화면명", "필드명", "속성명"),
    ),
    Kind(
        "address", ("주소",), r"(?:^|_)(?:[A-Z]*ADRES|[A-Z]*ADDR|ADDRESS)(?:_|$)", 6, 0,
        not_ending=("IP주소", "아이피주소", "URL주소", "웹주소", "홈페이지주소", "MAC주소", "접속주소", "서버주소"), not_containing=("주소록",),
        not_columns=r"(?:^|_)(?:IP|MAC|URL|WEB|SERVER|SVR|CONECT)_?(?:ADRES|ADDR|ADDRESS)(?:_|$)",
    ),
    Kind("account", ("계좌번호", "계좌"), r"(?:^|_)(?:ACNUTNO|ACCOUNT_?NO|ACNT_?NO|BANKBOOK_?NO|BACNT_?NO)(?:_|$)", 0, 4),
    Kind("card", ("카드번호",), r"(?:^|_)(?:CARD_?NO|CRDT_?CARD_?NO)(?:_|$)", 6, 4),
    Kind("birth", ("생년월일",), r"(?:^|_)(?:BRTHDY|BIRTH|BIRTHDAY|BIRTH_?DE|BRTH_?DE)(?:_|$)", 4, 0),
)


def _either(texts: list[Column], test) -> Column:
    """Whether the test holds for one of the texts, spaces left out; null texts never do."""
    found = F.lit(False)
    for t in texts:
        found = found | F.coalesce(test(F.replace(t, F.lit(" "), F.lit(""))), F.lit(False))
    return found


def _ends(texts: list[Column], endings: tuple[str, ...]) -> Column:
    """A name that ends in ...명 may also be written with ...이름."""
    every = [*endings, *(e[:-1] + "이름" for e in endings if e.endswith("명"))]
    return _either(texts, lambda t: reduce(or_, (t.endswith(e) for e in every), F.lit(False)))


def never_personal(column: Column, *texts: Column) -> Column:
    """Flags, codes, counts and titles are no personal values, whatever else their names say."""
    return F.upper(column).rlike(NEVER_COLUMNS) | _either(list(texts), lambda t: reduce(or_, (t.endswith(e) for e in NEVER_ENDINGS)))


def excluded(kind: Kind, column: Column, *texts: Column) -> Column:
    out = _ends(list(texts), kind.not_ending) | _either(list(texts), lambda t: reduce(or_, (t.contains(w) for w in kind.not_containing), F.lit(False)))
    return out | F.upper(column).rlike(kind.not_columns) if kind.not_columns else out


def personal_kind(column: Column, *texts: Column) -> Column:
    """The first kind that has a word in a text; if none, the first whose pattern fits the column's name; null if none does."""
    of_kind = lambda k, hit: F.when(hit & ~excluded(k, column, *texts), k.id)
    by_word = [of_kind(k, _either(list(texts), lambda t, k=k: reduce(or_, (t.contains(w) for w in k.words)))) for k in KINDS]
    by_name = [of_kind(k, F.upper(column).rlike(k.columns)) for k in KINDS]
    return F.when(~never_personal(column, *texts), F.coalesce(*by_word, *by_name))


def detect(columns: DataFrame) -> DataFrame:
    """table_name, name, kind of the columns (table_name, name, comment, and logical if there is one) that look personal."""
    texts = [F.col(c) for c in ("logical", "comment") if c in columns.columns]
    found = columns.withColumn("kind", personal_kind(F.col("name"), *texts))
    return found.where(F.col("kind").isNotNull()).select("table_name", "name", "kind")


def masked(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df with the given columns masked as their kinds say; a projection, never an update."""
    ends = {k.id: (k.head, k.tail) for k in KINDS}
    return df.withColumns({c: (mask_email if k == "email" else mask)(F.col(c), *ends[k]) for c, k in kinds.items()})


def update_texts(candidates: DataFrame, dialect: str) -> DataFrame:
    """table_name, sql: one UPDATE for each table of candidates (owner, table_name, name, kind, ordinal), in order of its columns.

    The text is for copies of a database; nothing here runs it."""
    column = quoted(F.col("name"), dialect)
    masked_sql = lambda k: (mask_email_sql if k.id == "email" else mask_sql)("‹c›", k.head, k.tail, dialect)
    expression = F.lit(None).cast("string")
    for k in KINDS:
        expression = F.when(F.col("kind") == k.id, F.replace(F.lit(masked_sql(k)), F.lit("‹c›"), column)).otherwise(expression)
    sets = F.array_sort(F.collect_list(F.struct("ordinal", F.concat(column, F.lit(" = "), expression).alias("text"), F.concat(column, F.lit(" IS NOT NULL")).alias("test"))))
    joined = lambda field, by: F.array_join(F.transform("sets", lambda x: x[field]), by)
    table = F.concat(F.coalesce(F.concat(quoted(F.col("owner"), dialect), F.lit(".")), F.lit("")), quoted(F.col("table_name"), dialect))
    grouped = candidates.groupBy("owner", "table_name").agg(sets.alias("sets"))
    return grouped.select("table_name", F.concat(F.lit("UPDATE "), table, F.lit(" SET "), joined("text", ", "), F.lit(" WHERE "), joined("test", " OR "), F.lit(";")).alias("sql"))
