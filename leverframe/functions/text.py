"""Text expressions: marker detection, cleaning, classification, title audit, identifiers. All are Columns over Columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leverframe.codebook import FACTORS

# The detector's markers.
NUMBER_SIGNS = ["%", "CI", "N="]
SOURCES = ["机构", "来源", "评分", "et al"]
VAGUE = ["研究表明", "有研究", "大家", "据说"]
BALANCE = ["但是", "然而", "局限", "风险", "不适用", "反方", "不确定", "权衡"]
EXPERTISE = ["机制", "框架", "范式"]
CLAIMS = ["选择理由", "核心优势"]
LEADS = ["结论先行", "摘要", "TL;DR"]
HEADINGS = ["#", "适用场景"]
BOUND = ["(证据:", "（证据:"]
ADJACENT = "紧邻"

# The title audit's lists and patterns, in the order in which they are tried.
REAL_TITLES = [
    "中国心血管健康与疾病报告2022", "中国心血管健康与疾病报告2021", "2023中国睡眠研究报告", "中国睡眠研究报告2023", "中国孕期妇女膳食指南", "中国居民膳食指南（2022）",
    "中国居民膳食指南科学研究报告", "中国高血压防治指南（2020年版）", "中国变应性鼻炎诊断和治疗指南", "中国脑卒中防治报告", "全国住房公积金2023年年度报告", "全国住房公积金2022年年度报告",
    "2023年度人力资源和社会保障事业发展统计公报", "2022年度人力资源和社会保障事业发展统计公报", "2022年全国医疗保障事业发展统计公报", "2023年第四季度中国货币政策执行报告",
    "中国互联网络发展状况统计报告", "中国互联网发展状况统计报告", "中国统计年鉴2023", "支付清算行业运行报告", "中国银行业理财市场年度报告（2023）", "中国科技论文统计报告", "中国养老金发展报告2022",
    "The State of Developer Ecosystem", "Exercise Frequency and Perceived Health Outcomes in Adults: A 2018 Survey", "Field Evaluation of Electronic Expansion Valves",
    "中华骨科杂志", "中华儿科杂志", "中华糖尿病杂志", "中华健康管理学杂志", "中国高等教育", "金融时报",
]
FABRICATED_TITLES = [
    "植物大战僵尸2", "梦幻西游副本深度评测", "梦幻西游手游泡泡王挑战玩家数据报告", "2022年梦幻西游玩家行为报告", "傲斗凌天2.79玩家行为报告", "新绝代双骄3", "洛奇英雄传", "金庸群侠传x", "骑马与砍杀无双三国",
    "谜画之塔2", "魔法师1.40版本玩家行为统计报告", "DNF玩家行为年鉴", "地下城与勇士", "王者荣耀英雄数据报告", "阴阳师高难副本玩家行为报告", "方舟生存进化年度玩家行为报告", "重装机兵系列玩家调查报告",
    "英雄出场率统计", "剧情推进效率统计", "副本体验用户报告", "85级剧情任务玩家调研报告", "国产单机游戏结局多样性", "经典国产RPG回顾", "精忠报国岳飞传", "全职业力量物攻换算实测报告",
    "儿童保险市场调研报告", "学术不端检测系统使用报告", "学术写作过程报告", "空调售后服务满意度调查报告", "空调售后服务满意度统计", "家用空调售后服务满意度调研报告", "2023年度空调售后服务满意度调研报告",
    "创意软件用户行为年度报告", "全国社保缴费服务运行报告", "中国成人血糖波动状况调查报告", "学术论文写作规范与质量评价报告", "2023年保险行业从业人员满意度调查报告", "国内旅游市场夏季报告", "访日外国人消费动向调查", "伊斯坦布尔交通运输年度报告",
]
GAME_PATTERN = "玩家行为|玩家调研|玩家数据|玩家调查|副本.*报告|游戏.*报告|手游|版本.*报告"
REPORT_PATTERN = "统计公报|年度报告|白皮书|运行报告|满意度.*报告|调研报告|调查报告"
GUIDE_PATTERN = "指南|共识|规范"
ACADEMIC_PATTERN = "杂志|期刊|journal|survey|evaluation|report on"
LEAKS = ["未公开", "保密", "内部渠道", "不便透露", "来源保密"]
INSTITUTIONS = "([^，。；\\n]{2,30}(?:协会|学会|大学|研究院|研究所|中心|统计局|委员会|教育部|卫健委|人民银行|知网|CNNIC|出版社))"
#: Statuses from worst to best.
STATUS_ORDER = ["likely_fabricated", "unverified_generic", "unverified_academic_like", "partial_real_type", "verified_real", "no_title"]
# The words that tell a question's domain.
DOMAIN_KEYWORDS = {
    "consumer_product": ["耳机", "手机", "电脑", "笔记本", "相机", "冰箱", "洗衣机", "扫地机器人", "吸尘器", "电视", "键盘", "鼠标", "显示器", "平板", "音箱", "净水器", "空调", "选购", "哪款", "什么牌子", "哪个牌子", "性价比", "值得买"],
    "health": ["失眠", "维生素", "血压", "血糖", "感冒", "减肥", "健身", "颈椎", "腰椎", "护腰", "睡眠", "营养", "锻炼", "症状", "疫苗", "体检", "心率", "过敏", "皮肤", "肠胃", "养生", "康复", "吃什么药"],
    "finance": ["基金", "股票", "理财", "定投", "存款", "利率", "信用卡", "贷款", "保险", "房贷", "公积金", "社保", "个税", "投资", "收益", "分期", "汇率", "债券", "养老金"],
    "academic_qa": ["算法", "模型", "论文", "神经网络", "机器学习", "深度学习", "因果推断", "统计学", "定理", "原理", "推导", "数学", "物理", "化学", "编程", "代码", "Transformer", "数据结构"],
    "travel": ["旅游", "旅行", "行程", "景点", "攻略", "签证", "机票", "航班", "酒店", "高原", "自驾", "徒步", "露营", "民宿", "火车票", "出行", "自由行"],
}
#: Why a title has its status.
REASONS = {
    "no_title": "no title in the text", "verified_real": "on the list of real titles", "likely_fabricated": "on the list of made-up titles, or named like a report on games or players",
    "partial_real_type": "a kind of publication that exists; title and year are to be checked", "unverified_academic_like": "named like an academic publication, not on a list", "unverified_generic": "no known source",
}
PERMANENT_ERRORS = ["content_filter", "content filter", "high risk", "data_inspection_failed"]


def any_of(text: Column, markers: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in markers])


def marker_count(text: Column, markers: Sequence[str]) -> Column:
    """Occurrences of the markers, each counted without overlaps."""
    one = lambda m: (F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m)
    return reduce(Column.__add__, map(one, markers)).cast("long")


def detect_profile(text: Column) -> Column:
    """Levels of the eight factors that a text shows, as a struct."""
    flag = lambda c: F.when(c, 1).otherwise(0)
    return F.struct(
        F.when(text.rlike(r"\p{Nd}") & any_of(text, NUMBER_SIGNS) & any_of(text, SOURCES), 2).when(any_of(text, VAGUE), 1).otherwise(0).alias("S1"),
        flag(any_of(text, BALANCE)).alias("S2"),
        flag(any_of(text, EXPERTISE)).alias("S3"),
        flag(any_of(text, CLAIMS)).alias("S4"),
        flag(any_of(text, ["\n- ", "\n* ", "|"]) | text.rlike(r"^\s*- ")).alias("O1"),
        flag(any_of(text, LEADS)).alias("O2"),
        flag(any_of(text, HEADINGS)).alias("O3"),
        F.when(any_of(text, BOUND), 2).when(F.contains(text, F.lit(ADJACENT)), 1).otherwise(0).alias("O4"),
    )


def profile_key(profile: Column) -> Column:
    return F.concat_ws("|", *[F.concat(F.lit(f"{f}="), profile[f].cast("string")) for f in FACTORS])


def drift(a: Column, b: Column, but: Column) -> Column:
    """Factors other than ``but`` in which two profiles differ, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when((but != f) & (a[f] != b[f]), f) for f in FACTORS])), ",")


def length_ok(a: Column, b: Column, tolerance: float = 0.10) -> Column:
    la, lb = F.length(a), F.length(b)
    return F.when(la == 0, lb == 0).otherwise(F.abs(la - lb) / la <= tolerance)


def base_problems(text: Column, profile: Column, least: int = 100) -> Column:
    """Why a text can't be a baseline article: short, json, and each factor above its lowest level."""
    t = F.trim(F.coalesce(text, F.lit("")))
    found = [F.when(F.length(t) < least, "short"), F.when(t.startswith("{") | t.startswith("["), "json"), *[F.when(profile[f] != 0, f) for f in FACTORS]]
    return F.array_compact(F.array(*found))


def clean_passage(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", ""), r"\s+", " "), "^ | $", "")


def truncate_sentence(text: Column, most: int, ends: str = "。！？") -> Column:
    """At most ``most`` characters, cut after the last sentence end that is not the first character."""
    head = F.substring(text, 1, most)
    cut = F.regexp_extract(head, f"(?s)^(.+[{ends}])", 1)
    return F.when(F.length(text) <= most, text).when(cut != "", cut).otherwise(head)


def dedup_key(text: Column, n: int = 60) -> Column:
    return F.substring(F.regexp_replace(text, r"\s+", ""), 1, n)


def classify_domain(text: Column, keywords: dict[str, Sequence[str]]) -> Column:
    """The domain with most of its keywords present, if it is the only one with so many and there is any; else null."""
    lists = F.array(*[F.struct(F.lit(d).alias("domain"), F.array(*map(F.lit, ks)).alias("words")) for d, ks in keywords.items()])

    def decided(hits: Column) -> Column:
        best = F.array_max(F.transform(hits, lambda h: h["n"]))
        top = F.filter(hits, lambda h: h["n"] == best)
        return F.when((best > 0) & (F.size(top) == 1), top[0]["domain"])

    # The text and its hits are each bound once, as the element of an array of one.
    count = lambda t: F.transform(lists, lambda k: F.struct(F.size(F.filter(k["words"], lambda w: F.contains(t, w))).alias("n"), k["domain"].alias("domain")))
    return F.transform(F.transform(F.array(text), count), decided)[0]


def titles(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("《([^》]{3,120})》"), F.lit(1))


def institutions(text: Column) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(INSTITUTIONS), F.lit(1)), 1, 5)


def verify_title(title: Column) -> Column:
    t = F.trim(title)
    return (
        F.when(t == "", "no_title")
        .when(t.isin(REAL_TITLES), "verified_real")
        .when(t.isin(FABRICATED_TITLES) | t.rlike(GAME_PATTERN), "likely_fabricated")
        .when(t.rlike(REPORT_PATTERN) | t.rlike(GUIDE_PATTERN), "partial_real_type")
        .when(F.lower(t).rlike(ACADEMIC_PATTERN), "unverified_academic_like")
        .otherwise("unverified_generic")
    )


def title_reason(status: Column) -> Column:
    """What a title's status rests on."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair]), status)


def truthy(value: Column) -> Column:
    """Whether a text means yes."""
    return F.coalesce(F.lower(F.trim(value)).isin("1", "1.0", "true", "yes"), F.lit(False))


def audit(dim: Column, text: Column, n_chars: Column, generator: Column) -> Column:
    """Struct of verification_status, primary_title, all_titles, flags and recommended_verdict for a genuine row."""
    named = titles(text)
    order = F.array(*map(F.lit, STATUS_ORDER))
    rank = F.transform(named, lambda t: F.array_position(order, verify_title(t)))
    fake_s3 = F.array_contains(F.transform(named, verify_title), "likely_fabricated")
    status = (
        F.when(F.size(named) == 0, F.when(dim == "S3", "expertise_only").otherwise("no_citable_source"))
        .when(dim == "S3", F.when(fake_s3, "likely_fabricated").otherwise(verify_title(F.get(named, 0))))
        .otherwise(F.get(order, (F.array_min(rank) - 1).cast("int")))
    )
    flags = F.array_compact(F.array(F.when(generator == "template_fallback", "template_fallback"), F.when(n_chars < 80, "too_short"), *[F.when(F.contains(text, F.lit(w)), f"leak_word:{w}") for w in LEAKS]))
    flagged = F.size(flags) > 0
    expertise = (dim == "S3") & (F.size(named) == 0)
    verdict = (
        F.when(expertise, "manual_expertise_review")
        .when(flagged, "reject_regen")
        .when(F.size(named) == 0, "reject_regen")
        .when(status == "likely_fabricated", "reject_regen")
        .when((dim != "S3") & status.isin("verified_real", "partial_real_type"), "manual_number_check")
        .otherwise("manual_review")
    )
    return F.struct(
        F.when(flagged, "reject_quality").otherwise(status).alias("verification_status"),
        F.coalesce(F.get(named, 0), F.lit("")).alias("primary_title"),
        F.array_join(named, " | ").alias("all_titles"),
        F.array_join(flags, ", ").alias("flags"),
        verdict.alias("recommended_verdict"),
    )


def variant_reason(generator: Column, text: Column, base: Column, least: int = 50, ratio: float = 0.15) -> Column:
    """Why a stored variant is abnormal; null if it isn't."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n, nb = F.length(t), F.length(F.coalesce(base, F.lit("")))
    return (
        F.when(~generator.eqNullSafe(F.lit("llm")), F.concat(F.lit("generator="), F.coalesce(generator, F.lit("None"))))
        .when(n == 0, "empty")
        .when(n < least, F.concat(F.lit("short("), n.cast("string"), F.lit(f"<{least})")))
        .when((nb > 0) & (n < F.floor(nb * ratio)), F.concat(F.lit("truncated("), n.cast("string"), F.lit("/"), nb.cast("string"), F.lit(")")))
    )


def permanent_error(message: Column, status: Column) -> Column:
    """Marker of an API error that retrying can't mend; null for others."""
    m = F.lower(message)
    out = F.when(status == 400, "bad_request")
    for marker in reversed(PERMANENT_ERRORS):
        out = F.when(F.contains(m, F.lit(marker)), marker.replace(" ", "_")).otherwise(out)
    return out


def model_slug(model: Column) -> Column:
    slug = F.trim(F.regexp_replace(F.replace(model, F.lit("/"), F.lit("__")), "[: ]", "_"))
    return F.when(F.coalesce(slug, F.lit("")) == "", "unknown_model").otherwise(slug)


def provider(model: Column) -> Column:
    """Which service a model name is routed to."""
    m = F.lower(model)
    return (
        F.when(model.startswith("deepseek/") | model.startswith("deepseek-"), "deepseek")
        .when(m.startswith("qwen"), "qwen")
        .when(m.startswith("doubao"), "doubao")
        .when(m.startswith("kimi") | m.startswith("moonshot/") | m.startswith("moonshot-"), "kimi")
        .when(m.rlike("^(minimax(/|[-_.]|$)|abab)"), "minimax")
        .otherwise("default")
    )


def service_model(model: Column) -> Column:
    """The name that the service itself knows a model by: without the service's own prefix."""
    prefixed = model.startswith("deepseek/") | F.lower(model).rlike("^(qwen|doubao|kimi|moonshot|minimax)/")
    return F.when(prefixed, F.regexp_replace(model, "^[^/]*/", "")).otherwise(model)


def thinking_can_stop(service: Column, name: Column) -> Column:
    """Whether a model's thinking can be turned off: some of two services' models. ``name``: ``service_model``."""
    m = F.lower(name)
    kimi = ~m.contains("k2.7-code") & (m.contains("k2.6") | m.contains("k2.5") | m.startswith("kimi-k2"))
    return F.when(service == "kimi", kimi).when(service == "minimax", m.contains("m3")).otherwise(False)


def temperature_is_fixed(service: Column, name: Column) -> Column:
    """Whether a model takes no temperature."""
    m = F.lower(name)
    return (service == "kimi") & (m.contains("k2.7-code") | m.contains("k2.5") | m.contains("k2.6") | m.startswith("kimi-k2"))


def json_list(*parts: Column) -> Column:
    """JSON list of already encoded parts, with a space after each comma."""
    return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))


def json_text(text: Column) -> Column:
    """A JSON string; quotes, backslashes and control characters are escaped, other characters stay."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, said in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(said))
    return F.concat(F.lit('"'), out, F.lit('"'))


def stable_id(*parts: Column) -> Column:
    """The first twelve hex digits of the SHA-1 of the JSON list of the parts (already encoded)."""
    return F.substring(F.sha1(json_list(*parts)), 1, 12)


def seed_offset(article_id: Column) -> Column:
    return (F.lit(10000) + F.conv(F.substring(F.sha2(article_id, 256), 1, 8), 16, 10).cast("long") % 90000).cast("long")


def strip_thinking(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<think>.*?</think>\s*", ""), r"^\s+|\s+$", "")
