"""Words, patterns and constants that results depend on, as the blueprint lists them."""

CONNECTORS = [
    "首先", "其次", "然后", "最后", "第一", "第二", "第三",
    "因此", "所以", "因而", "于是", "从而", "由此可见",
    "综上所述", "总而言之", "一言以蔽之", "总的来说",
    "此外", "另外", "除此之外", "不仅如此", "而且",
    "但是", "然而", "不过", "可是",
    "比如", "例如", "譬如",
]
PASSIVE = ["被", "受到", "得到", "加以", "由[^，。！？!?]{0,12}(完成|实现|触发|构成|导致|决定)"]
THREE_PART = ["(首先|第一).{2,40}(其次|第二).{2,40}(最后|第三)", "(一方面|从一方面).{2,30}(另一方面|从另一方面)"]
META = [
    "(修改后|改写后|可以改成|如果你愿意|建议改成)",
    "(以下是|上面是|这段是).{0,12}(修改|改写|润色)",
    "(值得|需要)(注意|指出|强调)的是",
    "(显而易见|毫无疑问|毋庸置疑|不言而喻)",
]
DASH = ["——(即|也就是|这意味着|这表明)"]
WORD_RUN = "[\\x{4e00}-\\x{9fff}]+"

#: Review signals by code, and the order in which one of several is primary.
RHYTHM_CODES = ["low_sentence_variation", "low_adjacent_sentence_delta", "low_extreme_sentence_ratio", "uniform_sentence_groups"]
FORCED_CODES = ["zh.fit.future_outlook_heading", "zh.fit.abstract_future_hype", "zh.fit.over_smooth_closure"]
LADDER_CODE = "zh.fit.conclusion_before_journey"
CLICHE_STATS = ["high_connector_density", "high_passive_ratio", "low_lexical_diversity"]
PRIORITY = ["need_interview", "missing_evidence", "author_fit_low", "forced_summary", "perfect_ladder", "uniform_sentence_length", "cliche_phrase"]
NOTE = "这些只是疑似片段，需要调用方进一步判断是否真的是 AI 生成"

#: Rewrite patterns.
IMPORTANT = "真正重要的是[，,、 ]*"
ESSENCE = "(本质上|归根结底|说白了|说穿了|换句话说)[，,、 ]*"
ROOT, KEY = "底层逻辑", "关键处"
NOT_BUT_CODES = ["zh.arg.not_x_but_y", "zh.arg.not_about_x_but_y"]
