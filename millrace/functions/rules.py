"""Default rule tables. All are fixed values that the retrieval rules are defined by; every function takes others."""

# --- pages and chunks ---
DISCARDED_BLOCKS = ("page_header", "page_footer", "page_number")
SKIPPED_BLOCKS = ("image", "chart", "seal")
PAGE_NUMBER = r"^\d+-\d+-\d+$"
NUMBERED_HEADING = r"^(第[一二三四五六七八九十]+[节章]\s*\S+)"
HEADINGS = ("目  录", "目录", "声 明", "声明", "重大事项提示", "释 义", "释义", "概 览", "概览")
UNKNOWN_SECTION = "未知"
PARAGRAPH_ENDS = "。；：！？）\""
SENTENCE_ENDS = "。！？；\n"
FULL_STOP = "。"
CHUNK_CHARS, OVERLAP_CHARS, LINE_CHARS, TABLE_CHARS = 800, 150, 30, 2000

# --- lexical search ---
STOP_WORDS = ("的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这")

# --- questions ---
INTENTS = ("financial", "risk", "business", "legal", "management", "comparison", "greeting", "unclear", "out_of_scope")
INTENT_PATTERNS = {
    "financial": (
        r"(收入|营收|盈利|利润|净利润|毛利率|净利率|成本|费用|资产|负债|现金流|财报|业绩)",
        r"(多少|金额|数值|比例|占比|增长率|同比|环比|ROE|净资产|市盈率)",
        r"(20\d{2}年?|近?期|上?年度|募集资金|IPO|上市)",
        r"(营业收入|营业利润|毛利|净利|总资产|总负债|应收账款)",
    ),
    "risk": (
        r"(风险|隐患|问题|挑战|不确定性|波动|下滑|亏损|退市)",
        r"(经营风险|市场风险|财务风险|法律风险|政策风险)",
        r"(有什么|存在|面临|可能|潜在|依赖|集中度|单一客户|应收账款|坏账|商誉)",
    ),
    "business": (
        r"(业务|主营业务|产品|服务|客户|市场|行业|商业模式|领域|赛道|供应商)",
        r"(做什么|经营|提供|面向|定位|核心优势|竞争优势|竞争力|技术|研发|专利)",
        r"(主营|客户群体|市场份额|应用场景|解决方案|上下游|产业链|产品线|收入构成|营收构成)",
        r"(主营是什么|主要做什么|靠什么赚钱|盈利模式|产品介绍|业务介绍)",
        r"(发行|股本|总股本|发行后|公开发行|战略配售)",
        r"(注册资本|成立时间|成立日期|经营范围|注册地|法定代表人|公司类型)",
        r"(保荐机构|承销商|审计机构|律师事务所|评估机构)",
        r"(子公司|分公司|控股|参股|关联方|合资)",
        r"(股权结构|股权|持股比例|控股股东|实际控制人|股东构成)",
    ),
    "legal": (r"(诉讼|仲裁|法律|合规|违法|违规|处罚|监管|行政处罚)", r"(知识产权|专利纠纷|侵权|未决|进行|涉及|存在|纠纷)"),
    "management": (
        r"(董事长|总经理|高管|管理层|创始人|实际控制人|股东|董事|监事)",
        r"(核心团队|高管薪酬|持股比例|团队背景|管理层介绍|谁创办)",
        r"(是谁|姓名|名字|背景|经历|持股)",
    ),
    "comparison": (r"(对比|比较|vs|versus|差距|差异|变化|趋势)", r"(和|与|跟|相比|同期|历年)"),
    "greeting": (r"^(你好|您好|嗨|hello|hi|在吗|在嘛)\s*[!.。]?$", r"^(谢谢|感谢|再见|拜拜)\s*[!.。]?$"),
}
ENTITY_PATTERNS = {
    "TIME": r"(20\d{2}年?|(?:最近|近)[一二三四五六七八九十\d]*年|近?期|上?年度|本?年度)",
    "MONEY": r"(\d+[.,]?\d*\s*[万亿]?元|\d+[.,]?\d*\s*万?元)",
    "PERCENT": r"(\d+[.,]?\d*\s*%|百分之[\d一二三四五六七八九十]+)",
    "COMPANY": r"([^\s]{2,10}(?:公司|集团|股份|企业|科技))",
    "PERSON": r"([^\s]{2,4}(?:董事长|总经理|CEO|总裁|创始人|实控人|股东))",
}
RELATIVE_YEARS = (("去年", -1), ("今年", 0), ("前年", -2))
YEAR_SUFFIX = "年"
PHRASES = (("近期", "最近"), ("上期", "上一期"))
COMPARED_COMPANY = r"([^\s]{2,10}(?:公司|集团))"
METRICS, DEFAULT_METRIC = ("营收", "收入", "利润", "净利润", "毛利率", "成本", "资产"), "财务数据"
CONJUNCTIONS = ("和", "与")
VAGUE = r"的([^是什有]{2,15})(?:是什么|有哪些|是怎样的|怎么样|如何)"
VAGUE_VERBS = {
    "技术标准": ("参与制定的", "参与制定的行业"),
    "资质": ("获得的", "取得的"),
    "荣誉": ("获得的", "荣获的"),
    "奖项": ("获得的", "荣获的"),
    "认证": ("获得的", "通过的"),
    "专利": ("拥有的", "申请的"),
    "核心技术": ("掌握的", "自主研发的"),
    "竞争优势": ("具备的", "主要的"),
}
STRUCTURE_WORDS = ("下设", "部门构成", "组成部分", "由哪些部门", "部门设置", "组织架构", "销售部", "市场部")
STRUCTURE_SUFFIX, DEPARTMENT, DEPARTMENT_AS = "下设", "部门", "组织结构"
COMPANY_FACTS = ("注册资本", "成立时间", "成立日期", "经营范围", "主要业务", "主营业务")
PARENT_NAMES, OF_COMPANY, OF_PARENT, PARENT = ("母公司", "发行人"), "公司的", "母公司（发行人）的", "母公司（发行人）"
NO_TIME_NEEDED = (
    r"(募集资金|发行|IPO|上市|新股|招股|发行价|定价)",
    r"(最新|当前|最近一期|截至|目前|现在)",
    r"(结构|占比|比例|构成|明细|分布)",
    r"(补充流动|投资|扩产|偿还|项目)",
    r"(注册资本|成立|注册时间|注册日期)",
    r"(变化趋势|趋势|走势|变化情况|变动|波动|历史|历年)",
)
PRONOUNS = ("该公司", "这家公司", "该企业", "它")
COMPANY_SIGNS = (r"(公司|企业|发行人|本[公企])", r"(营收|收入|利润|资产|负债|风险|业务|产品|技术|专利|股本|发行)")
# what a question that needs clarification is answered with, by reason
CLARIFY_TEXTS = {
    "unclear": "抱歉，我没有理解您的问题。您可以问关于公司财务、业务、风险、管理层等方面的问题。",
    "out_of_scope": "抱歉，这个问题超出了我的知识范围。我只能回答关于招股说明书内容的问题。",
    "time": "您想了解哪个时间段的财务数据？比如2023年或2024年。",
    "pronoun": "您指的是{company}吗？",
    "company": "请问您指的是哪家公司？当前可查询以下知识库：{bases}。您可以直接说公司全称或简称。",
}
BASE_QUOTE, BASE_COMMA = '"', "、"
COMPARISON = r"(对比|比较|vs|versus|和.*(?:相比|之间|的.*和)|与.*相比)"

# --- sections by question ---
INTENT_SECTIONS = {
    "financial": ("第八节 财务会计信息与管理层分析", "重大事项提示"),
    "risk": ("第四节 风险因素", "重大事项提示"),
    "business": ("第五节 发行人基本情况", "第六节 业务与技术", "重大事项提示"),
    "legal": ("第五节 发行人基本情况", "第七节 公司治理与独立性", "重大事项提示"),
    "management": ("第七节 公司治理与独立性", "第五节 发行人基本情况"),
    "comparison": ("第八节 财务会计信息与管理层分析",),
}
KEYWORD_SECTIONS = {
    "注册资本": ("第二节 概览", "第五节 发行人基本情况", "未知"),
    "成立时间": ("第二节 概览", "第五节 发行人基本情况", "未知"),
    "成立日期": ("第二节 概览", "第五节 发行人基本情况", "未知"),
    "主营业务": ("第二节 概览", "第六节 业务与技术"),
    "主要业务": ("第二节 概览", "第六节 业务与技术"),
    "仓储": ("第六节 业务与技术",),
    "物流": ("第六节 业务与技术",),
    "供应商": ("第六节 业务与技术",),
    "客户": ("第六节 业务与技术",),
    "经营范围": ("第二节 概览", "第五节 发行人基本情况"),
    "产品": ("第六节 业务与技术",),
    "技术标准": ("第六节 业务与技术",),
    "专利": ("第六节 业务与技术",),
    "竞争优势": ("第六节 业务与技术",),
    "发行价": ("第三节 本次发行概况",),
    "发行股数": ("第三节 本次发行概况",),
    "发行": ("第三节 本次发行概况", "第二节 概览"),
    "总股本": ("第三节 本次发行概况", "第五节 发行人基本情况"),
    "募集资金": ("第九节 募集资金运用与未来发展规划",),
    "募投项目": ("第九节 募集资金运用与未来发展规划",),
    "保荐机构": ("第三节 本次发行概况",),
    "承销商": ("第三节 本次发行概况",),
    "独立董事": ("第七节 公司治理与独立性",),
    "董事长": ("第七节 公司治理与独立性",),
    "总经理": ("第七节 公司治理与独立性",),
    "实际控制人": ("第五节 发行人基本情况",),
    "股东": ("第五节 发行人基本情况",),
    "股权结构": ("第五节 发行人基本情况",),
    "风险": ("第四节 风险因素",),
    "净利润": ("第八节 财务会计信息与管理层分析",),
    "营收": ("第八节 财务会计信息与管理层分析",),
    "毛利率": ("第八节 财务会计信息与管理层分析",),
    "控股股东": ("第五节 发行人基本情况", "第二节 概览"),
    "持股比例": ("第五节 发行人基本情况", "第三节 本次发行概况"),
}
UNROUTED = (r"^(你好|您好|嗨|hello|hi)", "介绍一下", "概况", "综合", "整体", "全面")

# --- query log ---
PATTERN_STOPS = "的了吗呢吧啊是在有和与"
