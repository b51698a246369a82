"""Character classes, word lists, patterns and terms that results depend on."""

# Blank characters, spelt out because engines disagree on \s.
WS = r"[\s\x{0B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_WS = r"[^\s\x{0B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# Characters that make a text look like a formula (48).
MATH = "⋆⊤∈∀∃≤≥≠≈∂∇∑∏∫√∥⊙⊗←→⇒⇔∞λνθϕφηζγβαμσΣΩΛΦΨΓΔ⌊⌋⌈⌉ˆ˜"
# Characters found in formulas and in prose.
SOFT_MATH = "=+×÷±∑∏∫√≤≥≠≈∈∀∃∂∇⊤⋆λθσμαβγδεπρτφψΩΛΦΓΔ^_{}\\"
# Characters found in formulas only.
HARD_MATH = "∂∑∏∫√⋆⊤∈∀∃≤≥≠≈∇⊙⊗⌊⌋⌈⌉ˆ˜λθσμαβγδεπρτφψωΩΛΦΨΓΔ"

# Function words of the layout rules (33).
STOPWORDS = (
    "the of a an is are was we in to for that with and this be as by on it not our their which can from at or has have these "
    "its but"
).split()
# Function words of the audit (47).
AUDIT_STOPWORDS = (
    "the of a an is are was were we in to for that with and this be as by on it not our their which can from at or has have "
    "these those but more than when if also each may such both into they its because"
).split()

CAPTION = r"(?i)^(Table|Figure|Fig|Panel|Chart|Exhibit)" + WS + r"*\.?" + WS + r"*[A-Z]?\.?" + WS + r"*[0-9]+"
PAGE_NUMBER = r"(?i)^[ivxlcdm]{0,7}[0-9]{0,4}\z"
PAGE_NUMBER_MODEL = r"(?i)^[ivxlcdm]{1,7}\z|^[0-9]{1,4}\z"
NUMBERED = r"^([A-Z]\.)?[0-9]+(\.[0-9]+)*" + WS + r"*[A-Z]"
NUMBERED_MODEL = r"^(?:[A-Z]\.)?[0-9]+(?:\.[0-9]+)*\.?" + WS + r"*[A-Za-z]"
SENTENCE = r"^[A-Z][a-z]+[,;]?" + WS + r"+[a-z]"
BOLD = r"(?i)bold|black|heavy|semib|demib|[-_]bd\b|BX"
SHORT_TITLE = r"^[A-Z][A-Za-z]{2,}(" + WS + r"+[A-Za-z]+){0,3}\z"
WORD = r"[a-z][a-z'-]+"
CONTINUES = r"^[a-z(,;]"
ENDED = r"[.!?:;)\"”]" + WS + r"*\z"
OTSL_CELL = r"<(?:fcel|ecel)>"
FORMULA = r"\\\[|\\begin\{|\\frac|\\sum|\$\$"
# A formula within a text: two kinds shown by themselves, two in the running text.
FORMULA_IN_TEXT = r"(?s)\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\$" + NOT_WS[:-1] + r"$][^$\n]*?\$"
# What a line of markdown begins with, by kind, and marks within a line with what replaces them.
LINE_MARKS = (("h", r"#{1,4}" + WS + "+"), ("ul", WS + "*[-*+]" + WS + "+"), ("ol", WS + "*[0-9]+[.)]" + WS + "+"))
INLINE_MARKS = ((r"`([^`]+)`", "<code>$1</code>"), (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), (r"(^|[^*])\*([^*\n]+)\*", "$1<em>$2</em>"))
MARKER = r"(?m)^<<<([0-9]+)>>>[ \t]*$"

TRANSLATED_KINDS = ("heading", "para", "caption", "note")
#: What a verdict must be for a repair, and the answers offered, by type of suspect.
VERDICTS = {
    "text-as-image": ("text", ("text", "graphic")),
    "split": ("one", ("one", "two")),
    "cut": ("yes", ("yes", "no")),
    "missing": ("figure", ("figure", "no")),
}

# What a model that sees is told, and what it is asked about a suspect by its type; {caption} is the suspect's caption.
VERDICT_RULES = (
    'You check the layout of pages. Look at the pictures and answer with one JSON object only: {"verdict": "<one of the options>", '
    '"reason": "<at most 20 words>"}. Take the verdict from the options as they stand; write nothing else and guess no coordinates.'
)
QUESTIONS = {
    "text-as-image": "This was cut out of a page as an image. What is it mostly? text: running prose, lists or references that are to be read as text. graphic: a chart, table, formula, drawing, photograph or code that must stay as it is. Say text only if almost all of it is connected sentences.",
    "split": "This area is now in several pieces with texts between them. Can it be one picture? one: all of it belongs to figures or tables, their heads, legends and parallel small tables included, and no prose to be translated is lost. two: paragraphs, section headings or remarks that don't belong to a figure stand in it.",
    "cut": "The first picture is what was cut out; the second reaches a little further. Does what the second adds belong to the same figure or table? yes: a head, axis labels, a legend, last rows. no: prose, a running head or another figure.",
    "missing": "There is a caption, \"{caption}\", without a figure. This was cut out near it. figure: it is a figure or table. no: it is prose, blank or a scrap.",
}

# Terms and their translations (67), in the order in which they are looked for.
GLOSSARY = {
    "end-to-end": "端到端", "two-stage": "两阶段", "predict-then-optimize": "先预测再优化",
    "expected return": "期望收益", "cross-sectional": "截面", "cross-section": "截面",
    "risk aversion": "风险厌恶", "risk preference": "风险偏好", "risk tolerance": "风险容忍度",
    "mean-variance": "均值-方差", "efficient frontier": "有效前沿", "tangency portfolio": "切点组合",
    "minimum-variance": "最小方差", "long-only": "只做多", "long-short": "多空",
    "short leg": "空头腿", "long leg": "多头腿", "turnover": "换手率",
    "transaction cost": "交易成本", "market friction": "市场摩擦", "drawdown": "回撤",
    "Sharpe ratio": "夏普比率", "out-of-sample": "样本外", "in-sample": "样本内",
    "rolling window": "滚动窗口", "look-ahead bias": "前视偏差",
    "stochastic discount factor": "随机贴现因子", "asset pricing": "资产定价",
    "pricing function": "定价函数", "firm characteristics": "公司特征", "predictor": "预测变量",
    "factor zoo": "因子动物园", "anomaly": "异象", "microcap": "微盘股",
    "shell-value premium": "壳价值溢价", "A-share": "A股", "bilevel": "双层",
    "lower-level problem": "下层问题", "upper-level problem": "上层问题",
    "decision loss": "决策损失", "decision-aware": "决策感知", "optimization layer": "优化层",
    "differentiable convex optimization": "可微凸优化", "implicit function theorem": "隐函数定理",
    "KKT conditions": "KKT 条件", "complementary slackness": "互补松弛", "dual variable": "对偶变量",
    "linear program": "线性规划", "second-order cone program": "二阶锥规划",
    "backpropagation": "反向传播", "gradient descent": "梯度下降",
    "parametric portfolio policy": "参数化组合策略", "deep reinforcement learning": "深度强化学习",
    "neural network": "神经网络", "equal-weighted": "等权", "value-weighted": "市值加权",
    "basis points": "基点", "estimation error": "估计误差", "parameter uncertainty": "参数不确定性",
    "robust optimization": "稳健优化", "shrinkage": "收缩", "covariance matrix": "协方差矩阵",
    "utility": "效用", "portfolio weights": "组合权重", "rebalancing": "再平衡",
    "VWAP": "成交量加权平均价", "limits to arbitrage": "套利限制",
}


def char_class(characters: str) -> str:
    """A pattern for any of the characters, good for both engines."""
    return "[" + "".join("\\" + c if c in "\\^[]{}-=+" else c for c in characters) + "]"
