"""Domain packs: everything that depends on language or subject. ZH is for Chinese engineering prose; LATIN for prose with spaces."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pack:
    # The patterns and lists that defaults hold.
    sentence_end: str = "。！？；"
    min_sentence: int = 6
    min_paragraph: int = 8
    chapter: str = r"^第[一二三四五六七八九十0-9]+章\s*[^\n]{0,40}$"
    section: str = r"^\d+(?:\.\d+){1,3}\s+[^\n]{0,60}$"
    named_sections: bool = True  # whether such a line names the section of later ones; it is no paragraph either way
    drop_spaces: bool = True
    triggers: dict = field(default_factory=dict)
    weak_triggers: tuple = ()
    negations: tuple = ()
    neutral: str = ""  # characters between trigger and mention that don't part them
    particle: str = ""
    passive: tuple = ()
    passive_relations: tuple = ("develops", "manufactures")
    no_numeric_tail: tuple = ()
    patterns: tuple = ()  # (regex, relation, name, splits lists)
    pair_patterns: tuple = ()  # (regex with the middle as group 1, relation, name)
    list_separators: str = "、，,;；"
    numeric: tuple = ()  # (regex with head, num, unit; relation)
    measures: tuple = ()
    code: str = r"\b[A-Z]{1,3}-?\d{1,3}[A-Z]?\b"
    type_labels: dict = field(default_factory=dict)
    type_pairs: tuple = ()
    stop_terms: tuple = ()
    excluded_types: tuple = ("NUMERIC_VALUE",)
    relation_names: dict = field(default_factory=dict)
    intents: tuple = ()
    leads: dict = field(default_factory=dict)  # of answers, by intent; {a} and {b} are the entities
    heading: str = r"^\d+(?:\.\d+){0,3}\s"  # of chunks, beside those that `chunk_chapter` finds
    chunk_chapter: str = r"^第\s*[一二三四五六七八九十百0-9]+\s*章"
    opening: str = "导言"  # label of chunks before any heading
    body_label: str = "正文"  # of evidence without section and chapter
    # Words of the dependency rules.
    dependency_negations: tuple = ()
    dependency_passives: tuple = ()
    passive_bonus: tuple = ("manufactures", "develops", "uses_method")
    particles: tuple = ()
    particles_at_ends: tuple = ()
    modals: tuple = ()
    pronouns: tuple = ()
    generic_heads: tuple = ()
    vague_heads: tuple = ()  # regexes
    prepositions: tuple = ()  # regexes
    quantity: str = ""
    own_script: str = r"[一-龥]"
    type_guesses: tuple = ()  # (etype, regex) in order; the first that is found


# Relation ontology, patterns and word lists of the Chinese pack.
TRIGGERS_ZH = {
    "has_part": ["由其组成", "组成包括", "由…组成", "由…构成", "包括", "包含", "含有", "由..组成", "构成", "组成", "分为", "分成"],
    "is_a": ["是一种", "是一类", "属于", "称之为", "称为"],
    "used_for": ["应用于", "适用于", "用于", "用作", "使用于", "服务于", "面向"],
    "applied_to": ["应用到", "运用到", "推广至", "推广到"],
    "improves": ["显著提升", "大幅提升", "进一步提升", "改善", "增强", "强化"],
    "reduces": ["大幅降低", "显著降低", "进一步降低", "削弱", "抑制", "缓解", "缩小", "缩减"],
    "causes": ["导致", "造成", "引发", "致使"],
    "leads_to": ["使得"],
    "controls": ["控制", "调控", "调节", "调整", "操纵"],
    "driven_by": ["由…驱动", "由其驱动"],
    "drives": ["驱动", "推动"],
    "actuated_by": ["由作动器驱动"],
    "manufactures": ["研制", "制造", "生产"],
    "develops": ["研发", "开发", "提出了", "提出", "发展和完善", "发展", "完善", "设计了", "设计出"],
    "originates_from": ["起源于", "源于", "始于", "始建于", "诞生于"],
    "greater_than": ["远大于"],
    "less_than": ["远小于", "不超过"],
    "equals_to": ["相当于", "约等于", "近似为"],
    "depends_on": ["取决于", "依赖于", "决定于"],
    "affects": ["影响", "决定", "关系到", "关乎", "作用于"],
    "uses_method": ["采用", "采取", "借助", "通过", "运用", "利用"],
    "verifies": ["验证", "检验", "证明", "证实"],
    "implements": ["实现", "达成"],
    "satisfies": ["满足", "符合"],
    "needs": ["需要", "需求"],
    "solves": ["解决", "克服"],
    "located_at": ["位于", "处于", "处在", "安装于", "安装在", "设置于", "布置于"],
    "connected_to": ["连接", "对接", "连接到", "连接至", "铰接", "固连"],
    "combines_with": ["结合", "配合", "联合", "兼具", "兼作"],
    "transforms_to": ["转变为", "切换为", "变体为", "转化为", "变成"],
    "generates": ["产生", "生成", "形成"],
    "provides": ["提供", "给出"],
}
INVERSES = {"has_part": "part_of", "is_a": "instance_of", "developed_by": "develops", "depends_on": "enables", "controls": "controlled_by", "driven_by": "drives", "located_at": "contains", "connected_to": "connected_to", "transforms_to": "transformed_from", "generates": "generated_by"}
NUMERIC_RELATIONS = ("has_value", "greater_than_value", "less_than_value", "greater_than", "less_than", "equals_to")
GLOBAL_RELATIONS = ("instance_of", "is_a", "type_taxonomy")
UNITS_ZH = r"km/h|m/s|kt|kg|t|g|kw|kW|mw|MW|cm|mm|m|km|s|ms|min|h|N·m|Nm|N|度|°|°C|%|Mach|马赫|克|吨|公斤|公里|米|秒|分钟|小时|赫兹|Hz|Pa|kPa|MPa"
MEASURES_ZH = (
    r"\d+(?:\.\d+)?\s*(?:km/h|m/s|kt|kg|t|g|kw|kW|m|cm|mm|s|ms|km|kn|N·m|Nm|N|度|°|°C|%|Mach|马赫|克|吨|公斤|公里|米|秒|赫兹|Hz|分钟|小时|h)",
    r"\d+(?:\.\d+)?[×x]\d+(?:\.\d+)?\^?\d+",
    r"\d+\s*-\s*\d+\s*(?:km/h|m/s|kg|t|m|cm|mm|°|度|%|度/秒|kW|kw|N|N·m|Mach)",
)
_HEAD = r"(?P<head>[一-龥A-Za-z·\-]+?)"
_NUM = r"(?P<num>\d+(?:\.\d+)?)"
NUMERIC_ZH = (
    (rf"{_HEAD}(?:为|是|约为|约等于|大约为|达到了?|可达|不超过|超过)(?P<num>\d+(?:\.\d+)?(?:\s*[×x]\s*10\^?\d+)?)\s*(?P<unit>{UNITS_ZH})", "has_value"),
    (rf"{_HEAD}在{_NUM}\s*(?P<unit>{UNITS_ZH})(?:左右|附近|以上|以下)", "has_value"),
    (rf"{_HEAD}(?:大于|高于|不低于|至少){_NUM}\s*(?P<unit>{UNITS_ZH})", "greater_than_value"),
    (rf"{_HEAD}(?:小于|低于|不超过|至多){_NUM}\s*(?P<unit>{UNITS_ZH})", "less_than_value"),
)
PATTERNS_ZH = (
    (r"由(.{0,8}?)驱动", "driven_by", "由X驱动", False),
    (r"(?:包括|包含|含有|分为)", "has_part", "包括", True),
    (r"由(.{0,12}?)组成", "has_part", "由X组成", True),
    (r"(?:用于|适用于|应用于)", "used_for", "用于", False),
    (r"起源于", "originates_from", "起源于", False),
    (r"(?:研制|生产|制造)出?了?", "manufactures", "研制/制造", False),
    (r"(?:研发|开发)出?了?", "develops", "研发/开发", False),
    (r"是一种?", "is_a", "是一种", False),
    (r"位于", "located_at", "位于", False),
    (r"安装(?:在|于)", "located_at", "安装于", False),
    (r"(?:转变为|变体为|切换为)", "transforms_to", "转变为", False),
)
PAIR_PATTERNS_ZH = ((r"与(.{0,12}?)(?:连接|对接|铰接|固连)", "connected_to", "与X连接"), (r"和(.{0,12}?)(?:连接|对接|铰接|固连)", "connected_to", "和X连接"))
TYPE_LABELS_ZH = {
    "AIRCRAFT": "飞行器", "WING_CONFIGURATION": "机翼构型", "PARAMETER": "设计参数", "AERODYNAMIC_CONCEPT": "气动概念", "STRUCTURAL_COMPONENT": "结构部件", "CONTROL_METHOD": "控制方法", "PERFORMANCE_METRIC": "性能指标",
    "ORGANIZATION": "组织机构", "PERSON": "人物", "TECHNOLOGY": "技术", "MATERIAL": "材料", "FLIGHT_PHASE": "飞行阶段", "EQUATION": "公式", "CONCEPT": "概念",
}
TYPE_PAIRS_ZH = (("AIRCRAFT", "PARAMETER"), ("AIRCRAFT", "PERFORMANCE_METRIC"), ("AIRCRAFT", "WING_CONFIGURATION"), ("AIRCRAFT", "MATERIAL"), ("AIRCRAFT", "STRUCTURAL_COMPONENT"), ("STRUCTURAL_COMPONENT", "MATERIAL"), ("PERSON", "ORGANIZATION"), ("TECHNOLOGY", "AIRCRAFT"))
STOP_TERMS_ZH = ("是", "为", "在", "有", "无", "其", "之", "者", "部分", "情况", "状态", "方式", "方法", "需要", "需求", "要求", "影响", "决定", "可能", "进而", "因此", "通过", "使用", "采用", "利用", "来自", "之间", "两者", "三者", "其他", "其它", "上述", "下述", "目前", "近年", "随着", "随之", "结果", "结论", "讨论", "分析", "研究", "本文", "本章", "本节", "公式", "图表", "表格", "样品", "单一", "复杂")
RELATION_NAMES_ZH = {
    "组成": "has_part", "包含": "has_part", "包括": "has_part", "产生": "generates", "造成": "causes", "导致": "causes", "影响": "affects", "减少": "reduces", "降低": "reduces", "增加": "increases", "提高": "improves", "提升": "improves",
    "改善": "improves", "属于": "is_a", "是一种": "instance_of", "位于": "located_at", "用于": "used_for", "等于": "equivalent_to", "定义为": "defined_as", "has": "has_part",
}
#: (intent, regex, relation or None) in order of precedence.
INTENTS_ZH = (
    ("DEFINITION", r"^(.+?)是什么(\?|？)?$", "instance_of"),
    ("DEFINITION", r"^什么是(.+?)(\?|？)?$", "instance_of"),
    ("DEFINITION", r"(?:解释|定义)(.+?)(?:[\?？]|$)", "instance_of"),
    ("LIST_INSTANCE", r"(?:有哪些|哪些是|列举).*?(.+?)(?:[\?？]|$)", "instance_of"),
    ("VALUE", r"(.+?)(?:是)?多少(\?|？)?$", "has_value"),
    ("VALUE", r"(.+?)的值(?:是多少)?(\?|？)?$", "has_value"),
    ("CAUSE", r"(?:什么|哪些).*?(?:导致|引起|造成)(.+?)(?:[\?？]|$)", "causes"),
    ("CAUSE", r"(?:什么|哪些).*?(?:减少|降低)(.+?)(?:[\?？]|$)", "reduces"),
    ("CAUSE", r"(?:什么|哪些).*?(?:提高|增强|提升|改善)(.+?)(?:[\?？]|$)", "improves"),
    ("CAUSE", r"(?:什么|哪些).*?影响(.+?)(?:[\?？]|$)", "affects"),
    ("EFFECT", r"(.+?)(?:会|能)?(?:导致|引起|造成)什么", "causes"),
    ("EFFECT", r"(.+?)(?:会|能)?(?:减少|降低)什么", "reduces"),
    ("EFFECT", r"(.+?)(?:会|能)?(?:提高|增强|提升|改善)什么", "improves"),
    ("EFFECT", r"(.+?)(?:会|能)?影响什么", "affects"),
    ("LOCATION", r"(.+?)(?:在|位于)哪", "located_at"),
    ("CHAPTER", r"(.+?)(?:在哪章|出现在哪|哪章讨论)", "discussed_in"),
    ("PROPERTY", r"(.+?)的(.+?)是(?:什么|多少|哪些)", None),
    ("PROPERTY", r"(.+?)有(?:什么|哪些)(.+?)(?:[\?？]|$)", None),
    ("PROPERTY", r"(.+?)由什么组成", "has_part"),
    ("PROPERTY", r"(.+?)包(?:括|含)(?:什么|哪些)", "has_part"),
    ("RELATION", r"(.+?)(?:和|与|跟)(.+?)(?:的关系|的联系|有什么关系)", None),
    ("NEIGHBOR", r"(?:与|和|跟)(.+?)相关(?:的)?", None),
    ("NEIGHBOR", r"(.+?)(?:的)?(?:邻居|相邻|周围)", None),
    ("SUMMARY", r"^(?:总结|概述|介绍)(.+?)(?:[\?？]|$)", None),
)

# Word lists and patterns of the dependency rules.
PARTICLES_ZH = ("的", "了", "着", "过", "地", "得", "之", "且", "并", "及", "或", "和", "与")
MODALS_ZH = ("会", "能", "能够", "可", "可以", "应", "应当", "应该", "需要", "必须")
PRONOUNS_ZH = ("这", "这些", "那", "那些", "它", "它们", "他", "他们", "其", "本", "本节", "本章", "上述", "下述", "前述", "如下", "以下", "如上", "此外", "另外", "其中", "我们", "我", "你", "你们")
GENERIC_HEADS_ZH = (
    "研究内容", "本研究", "本工作", "本章", "本节", "本文", "结果", "结论", "讨论", "分析", "目标", "目的", "方法", "本方法", "过程", "中", "时", "前", "后", "上", "下", "内", "外", "情况", "状态", "方式", "情形", "条件",
    "以上分析结果", "上述分析", "分析结果", "结果显示", "变体过程中", "研究过程中", "试验过程中", "仿真过程中",
)
VAGUE_HEADS_ZH = ("过程中$", "^于", "^以上", "^上述", "^下述", "^如下")
PREPOSITIONS_ZH = (r"^(在|对|经|通过|借助|利用|采用|使用)[^一-龥A-Za-z]{0,5}", r"^(为|为了|因为|由于|根据|按照|依据|针对)[^一-龥A-Za-z]{0,5}")
#: Guesses of a term's type, in order of precedence.
TYPE_GUESSES_ZH = (
    ("_DROP_", r"^.*\d+(?:\.\d+)?\s*(?:%|度|度/秒|度每秒|km/h|m/s|km|kg|kw|kW|t|g|m|cm|mm|s|ms|秒|N·m|Nm|N|万|倍|气|时|°C?|赫兹|Hz|公里|米|克|吨|公斤)$"),
    ("PERSON", r"^[A-Z][a-zA-Z]{1,13}$"),
    ("AIRCRAFT", r"^[A-Z]+\d+[A-Z]?$"),
    ("WING_CONFIGURATION", "布局|构型|三维双翼|二维双翼"),
    ("ORGANIZATION", "公司|集团|局|院|中心|研究所|实验室|NASA|DARPA|波音|空客|通用原子|Aeronautics|Boeing|Airbus"),
    ("CONCEPT", "(?:前方|后方|上方|正上方|斜前方|斜后方|两端|顶部|底部|侧面|侧前方|侧后方|之间|中心)$"),
    ("AIRCRAFT", "翼型"),
    ("STRUCTURAL_COMPONENT", "翼肋|翼梁|蒙皮|桁架|翼板|副翼|翼面|翼根|翼尖|支柱|张线|U型槽|纵墙|长桁|主梁|铰链|嵌套网格|背景网格|对称面|端面|网格"),
    ("PARAMETER", "弦长|翼展|间距|上反角|攻角|安装角|面积|弯度|梢根比|展弦比|翼展比|雷诺数|马赫数|动压|升力系数|阻力系数|升力线斜率|因子|压力|时间步长|重量|长度|扭矩|弯矩|速度|总时间|迭代次数|功率|角度|公转角度|最大|最小"),
    ("AERODYNAMIC_CONCEPT", "升力|阻力|俯仰|偏航|滚转|失速|诱导阻力|干扰|下洗|上洗|涡|翼尖涡|气流|流动分离|压差|压区|高压区|低压区|气动"),
    ("CONTROL_METHOD", "控制|反馈|PID|滑模|鲁棒|自适应控制|动力学建模"),
    ("PERFORMANCE_METRIC", "航程|续航|巡航速度|升限|起降距离|载重|推重比|燃油效率"),
    ("TECHNOLOGY", "方法|技术|算法|模型|理论|计算|仿真|网格法|RANS|URANS|DES|LES|CFD|FEM"),
)
#: First lines of answers.
LEADS_ZH = {
    "DEFINITION": "关于「{a}」是什么，知识图谱中给出的回答如下：",
    "LIST_INSTANCE": "图谱中已收录的「{a}」类相关实体如下：",
    "VALUE": "「{a}」的相关数值/取值信息：",
    "CAUSE": "导致 / 影响「{a}」的因素：",
    "EFFECT": "「{a}」会带来 / 影响的结果：",
    "LOCATION": "「{a}」所处的位置 / 部位信息：",
    "CHAPTER": "「{a}」在论文中被讨论的章节：",
    "PROPERTY": "「{a}」的属性 / 参数信息：",
    "RELATION": "「{a}」与「{b}」之间的关系：",
    "SUMMARY": "图谱中关于「{a}」的关键信息汇总：",
    "NEIGHBOR": "「{a}」的相关三元组：",
    "UNKNOWN": "图谱中与「{a}」相关的信息：",
}

ZH = Pack(
    triggers=TRIGGERS_ZH,
    weak_triggers=("为", "是", "属于", "影响", "决定", "构成", "形成", "产生", "生成", "用于", "包括", "包含", "采用", "使用", "通过"),
    negations=("不", "未", "无", "非", "并未", "没有", "免", "勿"),
    neutral="，,的、和与及或而又也",
    particle="的",
    passive=("由", "被"),
    no_numeric_tail=("is_a", "instance_of", "located_at", "manufactures", "develops", "transforms_to", "has_part", "uses_method"),
    patterns=PATTERNS_ZH,
    pair_patterns=PAIR_PATTERNS_ZH,
    numeric=NUMERIC_ZH,
    measures=MEASURES_ZH,
    type_labels=TYPE_LABELS_ZH,
    type_pairs=TYPE_PAIRS_ZH,
    stop_terms=STOP_TERMS_ZH,
    relation_names=RELATION_NAMES_ZH,
    intents=INTENTS_ZH,
    leads=LEADS_ZH,
    dependency_negations=("不", "未", "无", "没", "非", "勿", "莫", "毋"),
    dependency_passives=("被", "由", "受"),
    particles=PARTICLES_ZH,
    particles_at_ends=(*PARTICLES_ZH, "，", "。", "；", "：", "、", " "),
    modals=MODALS_ZH,
    pronouns=PRONOUNS_ZH,
    generic_heads=GENERIC_HEADS_ZH,
    vague_heads=VAGUE_HEADS_ZH,
    prepositions=PREPOSITIONS_ZH,
    quantity=rf"^\s*\d+(?:\.\d+)?\s*(?:{UNITS_ZH})?\s*$",
    type_guesses=TYPE_GUESSES_ZH,
)

#: For the test tables: a heading is a line of one capitalised word, numbered lines (addresses, mostly) are left out and name no section; short words of the four languages are triggers.
LATIN = Pack(
    sentence_end=".!?",
    chapter=r"^[A-Z][a-z]{2,20}\.$",
    named_sections=False,
    drop_spaces=False,
    triggers={"part_of": [" of ", " der ", " de "], "located_at": [" in ", " en "], "combines_with": [" and ", " und ", " et ", " y "], "needs": [" the ", " la "]},
    weak_triggers=(" the ", " de "),
    negations=(" not ", " nicht ", " pas ", " no "),
    neutral=" ,",
    particle=",",
    no_numeric_tail=("part_of",),
    type_labels={"SHORT": "short term", "LONG": "long term"},
    type_pairs=(("SHORT", "LONG"),),
)
