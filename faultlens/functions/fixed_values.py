"""Fixed values.

Word lists, weights, rule tables, labels and constants below decide the results and must keep
exactly these values and this order.
"""

# --- masking: rule name, RE2 pattern, replacement (applied in this order) ---
MASK_RULES = [
    ("ip", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[IP_REDACTED]"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    ("secret", r"[A-Za-z0-9]{32,}", "[SECRET_REDACTED]"),
    ("token", r"(?i)(token|secret|key|password|passwd)[=:]\s*[^\s,;]+", r"\1=[SECRET_REDACTED]"),
]

# --- line weights and truncation ---
LEVEL_WEIGHTS = {
    "FATAL": 1.0, "ERROR": 1.0, "EXCEPTION": 0.9,
    "WARN": 0.6, "WARNING": 0.6,
    "INFO": 0.2, "DEBUG": 0.05, "TRACE": 0.05,
}
NO_LEVEL_WEIGHT = 0.1
DETAIL_PREFIXES = [" ", "\t", "at ", "Caused by"]
DETAIL_FLOOR = 0.8
EDGE_LINES = 3
MAX_TOKENS = 6000
BYTES_PER_TOKEN = 3

# --- error patterns ---
KEY_ERRORS = [
    "OutOfMemoryError", "Java heap space", "GC overhead",
    "NullPointerException", "ClassCastException",
    "Connection refused", "Connection timeout", "SocketTimeoutException",
    "SQLException", "Deadlock", "Lock wait timeout",
    "Disk full", "No space left",
    "CPU", "memory leak",
    "502", "503", "504",
    "Permission denied", "Access denied",
]
MAX_KEY_ERRORS = 10
RETRIEVAL_WORDS = [
    "502", "503", "500", "504", "401", "403",
    "ORA-01157", "ORA-01110",
    "OOM", "out of memory", "OutOfMemoryError", "memory leak",
    "memory pressure", "memory limit", "memory exhausted",
    "no space left", "disk full", "disk usage 100%", "disk space exhausted",
    "connection refused", "connection timeout", "connection reset",
    "bad gateway", "service unavailable", "unreachable",
    "permission denied", "access denied", "authentication failed",
    "deadlock", "lock wait timeout", "database corruption",
    "core dump", "COREDUMP", "killed", "oom-killer",
    "configuration file", "invalid parameter", "parse error",
    "CPU", "cpu credits", "high cpu", "throttled",
]
DEFAULT_WORDS = ["运维", "故障", "排查"]

# --- retrieval ---
TOP_K = 5
SCORE_THRESHOLD = 0.3
RRF_K = 60
LIKE_SCORE = 1.5
MIN_KEYWORD_BYTES = 2

# --- diagnosis ---
STRATEGIES = ["ZERO_SHOT", "FEW_SHOT", "COT"]
MODES = ["RAG", "DIRECT"]
MODEL_NAME = "deepseek-chat"
TEMPERATURE = 0.1
MAX_ANSWER_TOKENS = 2048
RETRY_WAITS = [0, 1, 2]
PARSE_FAILED = "解析失败"
TITLE_CHARS = 80
SNIPPET_CHARS = 500
SEED_TITLE_CHARS = 60
CASE_SNIPPET_BYTES = 120

CATEGORY_WORDS = {
    "内存": ["OOM", "OUT OF MEMORY", "MEMORY", "HEAP"],
    "磁盘": ["DISK", "SPACE", "NO SPACE", "IOEXCEPTION"],
    "网络": ["CONNECTION", "TIMEOUT", "NETWORK", "DNS", "SOCKET"],
    "数据库": ["DATABASE", "SQL", "DEADLOCK", "ORA-", "MYSQL"],
    "认证权限": ["PERMISSION", "DENIED", "AUTH", "UNAUTHORIZED"],
    "进程": ["KILLED", "CORE DUMP", "CRASH", "FATAL"],
    "配置": ["CONFIG", "PARAMETER", "PARSE", "INVALID"],
    "容器": ["KUBERNETES", "K8S", "DOCKER", "CONTAINER", "POD"],
}
LEARNED_CATEGORY = "自动学习"

# --- article texts: section labels ---
LEARNED_LABELS = ["【根因】", "【分析过程】", "【修复步骤】"]
SEED_LABELS = [
    "【故障分类】", "【根因分析】", "【触发条件】", "【影响范围】", "【关键词】", "【修复步骤】", "【典型日志特征】",
]

# --- article texts: (words, text), first rule with a word in the keywords wins ---
TRIGGER_RULES = [
    (["oom", "memory"], "内存使用率持续超过阈值（通常 >90%）；进程 RSS 接近物理内存上限；Swap 几乎耗尽。"),
    (["raid"], "RAID 阵列中 >=2 块盘离线；或热备盘未自动激活；阵列降级。"),
    (["disk", "ntfs"], "磁盘剩余空间低于 5%；或文件系统索引出现损坏；CHKDSK 反复触发。"),
    (["dns", "network", "connection"], "DNS 解析失败率 >10%；或关键端口监听消失；或跨节点连通性超时。"),
    (["token", "authentication", "permission"], "ServiceAccount token 缺失或过期；RBAC 权限变更未同步；或证书轮替失败。"),
    (["502", "500", "gateway"], "上游服务健康检查失败率 >50%；或后端实例可用数低于最小副本数。"),
    (["lock", "loop"], "同一错误日志在 10 秒内重复 >1000 次；或锁文件长期未释放。"),
]
TRIGGER_DEFAULT = "对应关键词在日志中高频出现且伴随 ERROR/CRITICAL 级别。"

IMPACT_BY_CATEGORY = {
    "OOM": "单节点服务不可用，可能触发级联崩溃；日志采集链中断导致监控盲区。",
    "磁盘": "数据写入失败，业务流程中断；严重时文件系统损坏需离线修复。",
    "网络": "跨节点通信异常，影响范围随故障层级扩散（DNS > 单机 > 机房）。",
    "代码缺陷": "逻辑性故障，影响特定业务路径；可能引发数据不一致。",
    "连接池": "API 吞吐量骤降，请求堆积触发雪崩；就绪探针失败导致服务被摘除。",
    "HTTP": "用户可见错误（5xx/502），影响 SLA；可能触发告警风暴。",
    "权限": "服务启动失败或关键操作被拒绝；可能影响安全审计合规。",
}
IMPACT_DEFAULT = "影响范围视故障传播路径而定，需结合监控指标评估。"

SOLUTION_RULES = [
    (["raid"], "1. 标识故障盘：megacli / storcli 查看状态\n2. 激活热备盘：确认配置权限充足\n3. 重建阵列：监控 rebuild 进度\n4. 复盘：校验热备盘策略和告警通道"),
    (["ntfs"], "1. 紧急清理：删除过期日志/临时文件\n2. 修复文件系统：umount 后运行 chkdsk / xfs_repair\n3. 如有累积更新：回滚 KB 补丁\n4. 长期：配置日志轮转和磁盘容量告警"),
    (["disk"], "1. 紧急清理：删除过期日志/临时文件\n2. 扩容：增加磁盘空间或挂载新卷\n3. 修复文件系统：umount 后运行 xfs_repair\n4. 长期：配置日志轮转和磁盘容量告警"),
    (["oom", "memory"], "1. 临时扩容：kubectl scale 增加副本数或垂直扩容内存\n2. 定位内存泄漏：抓取 pprof heap dump 分析\n3. 调整 OOM 评分：sysctl vm.swappiness 或调整 oom_score_adj\n4. 复盘：补内存告警阈值，设置提前预警"),
    (["dns"], "1. 临时规避：切换到备用 DNS（如 1.1.1.1）\n2. 抓包定位：tcpdump port 53 分析请求\n3. 修复客户端：升级固件或重启 DNS 服务\n4. 复盘：配置多级 DNS 冗余"),
    (["token", "authentication"], "1. 手动生成 token：kubectl create token\n2. 校验 RBAC：检查 RoleBinding/ClusterRoleBinding\n3. 重启 Pod：强制重新挂载 token\n4. 复盘：升级前预检 ServiceAccount 配置"),
    (["502", "gateway"], "1. 检查上游健康：curl 直接访问后端实例\n2. 扩容：手动增加副本数\n3. 调整探针：避免过早摘除\n4. 复盘：优化 HPA 指标（不只看 CPU）"),
    (["lock", "loop"], "1. 强制释放：删除 /var/lock/*.lock 文件\n2. 重启相关进程：systemctl restart\n3. 定位干扰源：审计近期变更\n4. 复盘：为锁文件加超时和告警"),
]
SOLUTION_DEFAULT = "1. 保留现场：日志快照 + 监控截图\n2. 临时恢复：重启/回滚到上一版本\n3. 根因定位：抓堆栈/trace\n4. 复盘：补充对应监控和告警规则"

# --- result files ---
RESULT_CSV_COLUMNS = [
    "case_id", "category", "mode", "strategy",
    "predicted_cause", "expected_cause", "is_correct",
    "confidence", "latency_ms", "knowledge_used", "tokens_used",
]
CASE_CATEGORIES = ["OOM", "网络", "代码缺陷", "连接池", "磁盘", "HTTP", "权限", "数据库", "CPU", "配置"]
