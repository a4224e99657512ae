"""The rule catalogue: one row per rule of the line scanner."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """A line matches if `pattern` does and `antipattern`, if any, doesn't. Patterns are RE2 dialect."""

    rule_id: str
    name: str
    language: str
    severity: str
    category: str
    cwe: str
    pattern: str
    antipattern: str | None
    description: str
    fix: str

    @property
    def message(self) -> str:
        return f"[{self.rule_id}] {self.name}: {self.description}"


# Identifiers, patterns and texts of the built-in rules.
RULES = [
    Rule(
        "SEC-GO-001", "SQL Injection", "go", "critical", "security", "CWE-89",
        r'fmt\.Sprintf\s*\(\s*"[^"]*(?:SELECT|INSERT|UPDATE|DELETE|DROP)[^"]*%[sv]',
        None,
        "String formatting used in SQL query construction; use parameterized queries instead",
        "Use parameterized queries with ? or $1 placeholders instead of fmt.Sprintf for SQL",
    ),
    Rule(
        "SEC-GO-002", "Command Injection", "go", "critical", "security", "CWE-78",
        r'exec\.Command\s*\([^"`][^,)]*\)',
        r'exec\.Command\s*\(\s*"[^"]+"\s*\)',
        "Potentially unsanitized input passed to exec.Command",
        "Validate and sanitize all input passed to exec.Command; use an allowlist of permitted commands",
    ),
    Rule(
        "SEC-GO-003", "Path Traversal", "go", "high", "security", "CWE-22",
        r"(?:os\.(?:Open|ReadFile|Create|WriteFile)|filepath\.Join)\s*\(.*(?:req\.|r\.|input|param|query|user)",
        r"filepath\.Clean",
        "User-controlled path used in file operations without filepath.Clean or validation",
        "Use filepath.Clean() and validate the resolved path is within the expected directory",
    ),
    Rule(
        "SEC-GO-004", "Hardcoded Secret", "go", "critical", "security", "CWE-798",
        r'(?i)(?:password|secret|api_?key|token|private_?key)\s*(?::?=|=)\s*"[^"]{4,}',
        "(?i)(?:test|example|placeholder|TODO|CHANGE|xxx|dummy)",
        "Hardcoded password or secret string detected",
        "Use environment variables or a secrets manager instead of hardcoded credentials",
    ),
    Rule(
        "SEC-GO-005", "Insecure TLS", "go", "high", "security", "CWE-295",
        r"InsecureSkipVerify\s*:\s*true",
        None,
        "TLS certificate verification is disabled",
        "Remove InsecureSkipVerify: true; configure proper TLS certificate validation",
    ),
    Rule(
        "SEC-GO-006", "Weak Crypto (MD5)", "go", "medium", "security", "CWE-328",
        r"md5\.(?:New|Sum)",
        "(?i)(?:checksum|fingerprint|cache|etag|non.?security)",
        "MD5 is cryptographically broken and should not be used for security purposes",
        "Use crypto/sha256 or crypto/sha512 instead of MD5 for security-sensitive operations",
    ),
    Rule(
        "SEC-GO-007", "Weak Crypto (SHA1)", "go", "medium", "security", "CWE-328",
        r"sha1\.(?:New|Sum)",
        "(?i)(?:git|fingerprint|cache|etag|non.?security)",
        "SHA-1 is deprecated for security use; collisions are practical",
        "Use crypto/sha256 or crypto/sha512 instead of SHA-1 for security-sensitive operations",
    ),
    Rule(
        "SEC-GO-008", "Unvalidated Redirect", "go", "medium", "security", "CWE-601",
        r"http\.Redirect\s*\(.*(?:r\.(?:URL|Form|Query)|req\.|param|input)",
        None,
        "HTTP redirect using user-controlled input without validation",
        "Validate redirect URLs against an allowlist of permitted destinations",
    ),
    Rule(
        "SEC-GO-009", "Sensitive Data in Log", "go", "medium", "security", "CWE-532",
        r"(?:log\.|slog\.|logger\.)(?:Print|Info|Debug|Warn|Error|Fatal).*(?i)(?:password|token|secret|key|credential)",
        r"(?i)(?:redact|mask|\*\*\*|<hidden>)",
        "Potentially logging sensitive data (passwords, tokens, secrets)",
        "Redact sensitive values before logging; never log passwords, tokens, or API keys",
    ),
    Rule(
        "SEC-GO-010", "Defer in Loop", "go", "medium", "correctness", "",
        r"^\s*defer\s+",
        None,
        "defer inside a loop can accumulate resources until the function returns",
        "Move the deferred call into a helper function or handle resource cleanup explicitly in the loop",
    ),
    Rule(
        "COR-GO-001", "Unchecked Error", "go", "medium", "correctness", "CWE-252",
        r"^\s*[a-zA-Z_][a-zA-Z0-9_.]*\s*\(.*\)\s*$",
        r"(?:^//|^\s*//|defer|go\s+|fmt\.Print|log\.|println|print\()",
        "Function return value that likely includes an error is discarded",
        "Capture and handle the returned error: if err != nil { return err }",
    ),
    Rule(
        "COR-GO-002", "Goroutine Leak Risk", "go", "medium", "correctness", "",
        r"\bgo\s+func\s*\(",
        r"(?:ctx|context|done|cancel|Done\(\)|quit|stop|timer|ticker)",
        "Goroutine launched without visible context cancellation or done channel",
        "Pass a context.Context or done channel to goroutines to enable graceful shutdown",
    ),
    Rule(
        "COR-GO-003", "Race Condition Risk", "go", "high", "correctness", "CWE-362",
        r"go\s+func\s*\([^)]*\)\s*\{[^}]*(?:[a-z]+\s*(?:\+\+|--|(?:\+|-|\*|/)=))",
        r"(?:mutex|Mutex|sync\.|atomic\.|Lock\(\)|chan\s)",
        "Shared variable access in goroutine without synchronization",
        "Use sync.Mutex, sync/atomic, or channels to synchronize shared state access",
    ),
    Rule(
        "COR-GO-004", "nil Map Write", "go", "high", "correctness", "",
        r"var\s+\w+\s+map\[",
        r"=\s*(?:make|map\[)",
        "Writing to a potentially nil map causes a runtime panic",
        "Initialize the map with make() before writing to it",
    ),
    Rule(
        "SEC-PY-001", "SQL Injection (f-string)", "python", "critical", "security", "CWE-89",
        r"""f["'](?:[^"']*(?:SELECT|INSERT|UPDATE|DELETE|DROP)[^"']*)\{""",
        None,
        "f-string used in SQL query construction; use parameterized queries",
        "Use parameterized queries with %s or ? placeholders passed as a tuple",
    ),
    Rule(
        "SEC-PY-002", "eval() Usage", "python", "critical", "security", "CWE-95",
        r"\beval\s*\(",
        r"(?i)(?:#.*safe|#.*trusted|ast\.literal_eval)",
        "eval() executes arbitrary code and is a common injection vector",
        "Use ast.literal_eval() for data parsing or find a safer alternative to eval()",
    ),
    Rule(
        "SEC-PY-003", "exec() Usage", "python", "critical", "security", "CWE-95",
        r"\bexec\s*\(",
        None,
        "exec() executes arbitrary code strings and is dangerous with user input",
        "Avoid exec(); use structured approaches like importlib or predefined function dispatch",
    ),
    Rule(
        "SEC-PY-004", "Pickle Deserialization", "python", "high", "security", "CWE-502",
        r"pickle\.loads?\s*\(",
        None,
        "pickle.loads() can execute arbitrary code during deserialization",
        "Use JSON or another safe serialization format; if pickle is required, only load from trusted sources",
    ),
    Rule(
        "SEC-PY-005", "Subprocess Shell Injection", "python", "high", "security", "CWE-78",
        r"subprocess\.(?:call|run|Popen|check_output|check_call)\s*\(.*shell\s*=\s*True",
        None,
        "subprocess with shell=True is vulnerable to shell injection",
        "Use shell=False (default) and pass command as a list instead of a string",
    ),
    Rule(
        "SEC-PY-006", "Assert in Production", "python", "low", "correctness", "CWE-617",
        r"^\s*assert\s+",
        r"(?i)(?:test_|_test\.py|conftest|pytest)",
        "assert statements are stripped with -O flag; do not use for validation",
        "Replace assert with explicit validation that raises an appropriate exception",
    ),
    Rule(
        "SEC-PY-007", "Hardcoded Secret (Python)", "python", "critical", "security", "CWE-798",
        r"""(?i)(?:password|secret|api_?key|token|private_?key)\s*=\s*["'][^"']{4,}["']""",
        "(?i)(?:test|example|placeholder|TODO|CHANGE|xxx|dummy|fake)",
        "Hardcoded password or secret string detected",
        "Use environment variables or a secrets manager instead of hardcoded credentials",
    ),
    Rule(
        "SEC-PY-008", "YAML Unsafe Load", "python", "high", "security", "CWE-502",
        r"yaml\.load\s*\(",
        r"Loader\s*=\s*(?:yaml\.)?SafeLoader",
        "yaml.load() without SafeLoader can execute arbitrary Python objects",
        "Use yaml.safe_load() or pass Loader=yaml.SafeLoader explicitly",
    ),
    Rule(
        "SEC-TS-001", "innerHTML Assignment", "typescript", "high", "security", "CWE-79",
        r"\.innerHTML\s*=",
        "(?i)(?:sanitize|DOMPurify|escape)",
        "Direct innerHTML assignment enables XSS attacks",
        "Use textContent for plain text or a sanitization library (DOMPurify) for HTML",
    ),
    Rule(
        "SEC-JS-001", "innerHTML Assignment", "javascript", "high", "security", "CWE-79",
        r"\.innerHTML\s*=",
        "(?i)(?:sanitize|DOMPurify|escape)",
        "Direct innerHTML assignment enables XSS attacks",
        "Use textContent for plain text or a sanitization library (DOMPurify) for HTML",
    ),
    Rule(
        "SEC-TS-002", "eval() Usage", "typescript", "critical", "security", "CWE-95",
        r"\beval\s*\(",
        None,
        "eval() executes arbitrary code and is a common injection vector",
        "Use JSON.parse() for data or Function constructor with extreme caution",
    ),
    Rule(
        "SEC-JS-002", "eval() Usage", "javascript", "critical", "security", "CWE-95",
        r"\beval\s*\(",
        None,
        "eval() executes arbitrary code and is a common injection vector",
        "Use JSON.parse() for data or Function constructor with extreme caution",
    ),
    Rule(
        "SEC-TS-003", "Prototype Pollution", "typescript", "high", "security", "CWE-1321",
        "__proto__",
        r"(?i)(?:hasOwnProperty|Object\.create\(null\))",
        "__proto__ access can lead to prototype pollution attacks",
        "Use Object.create(null) for lookup objects or validate keys against __proto__, constructor, prototype",
    ),
    Rule(
        "SEC-JS-003", "Prototype Pollution", "javascript", "high", "security", "CWE-1321",
        "__proto__",
        r"(?i)(?:hasOwnProperty|Object\.create\(null\))",
        "__proto__ access can lead to prototype pollution attacks",
        "Use Object.create(null) for lookup objects or validate keys against __proto__, constructor, prototype",
    ),
    Rule(
        "SEC-TS-004", "Regex DoS", "typescript", "medium", "security", "CWE-1333",
        r"(?:new RegExp|/).*(?:\+\+|\*\*|\{\d+,\}.*\{\d+,\}|(?:\.\*){2,}|\([^)]*\+\)[^)]*\+)",
        None,
        "Complex regex with nested quantifiers may be vulnerable to ReDoS",
        "Simplify regex; add bounds to quantifiers; consider using re2 or a timeout",
    ),
    Rule(
        "SEC-JS-004", "Regex DoS", "javascript", "medium", "security", "CWE-1333",
        r"(?:new RegExp|/).*(?:\+\+|\*\*|\{\d+,\}.*\{\d+,\}|(?:\.\*){2,}|\([^)]*\+\)[^)]*\+)",
        None,
        "Complex regex with nested quantifiers may be vulnerable to ReDoS",
        "Simplify regex; add bounds to quantifiers; consider using re2 or a timeout",
    ),
    Rule(
        "SEC-TS-005", "Hardcoded Secret (TS)", "typescript", "critical", "security", "CWE-798",
        r"""(?i)(?:password|secret|api_?key|token|private_?key)\s*[=:]\s*["'][^"']{4,}["']""",
        r"(?i)(?:test|example|placeholder|TODO|CHANGE|xxx|dummy|process\.env|import)",
        "Hardcoded password or secret string detected",
        "Use environment variables or a secrets manager instead of hardcoded credentials",
    ),
    Rule(
        "SEC-JS-005", "Hardcoded Secret (JS)", "javascript", "critical", "security", "CWE-798",
        r"""(?i)(?:password|secret|api_?key|token|private_?key)\s*[=:]\s*["'][^"']{4,}["']""",
        r"(?i)(?:test|example|placeholder|TODO|CHANGE|xxx|dummy|process\.env|import)",
        "Hardcoded password or secret string detected",
        "Use environment variables or a secrets manager instead of hardcoded credentials",
    ),
    Rule(
        "PERF-GO-001", "String Concat in Loop", "go", "low", "performance", "",
        r'\w+\s*\+=\s*(?:"|\w+)',
        r"(?:int|float|byte|rune|uint|count|total|sum|num|idx|index|offset|i\s*\+)",
        "String concatenation with += in a loop causes quadratic allocation",
        "Use strings.Builder for string concatenation in loops",
    ),
    Rule(
        "PERF-GO-002", "Unbounded Allocation", "go", "medium", "performance", "CWE-789",
        r"make\s*\(\s*\[\]\w+\s*,\s*(?:req\.|r\.|input|param|query|size|length|count|n\b)",
        r"(?:maxSize|maxLen|cap|min\(|max\(|limit|<=|>=|<\s*\d|>\s*\d)",
        "Slice allocation with user-controlled size without bounds check",
        "Validate and cap allocation sizes to prevent denial of service via memory exhaustion",
    ),
    Rule(
        "PERF-GO-003", "N+1 Query Pattern", "go", "medium", "performance", "",
        r"(?:\.Query|\.Exec|\.Get|\.Find|\.First|\.Select|\.Where)\s*\(",
        r"(?:batch|bulk|IN\s*\(|ids|Preload|Join)",
        "Database query inside a loop suggests N+1 query problem",
        "Batch database queries outside the loop; use IN clauses or JOINs",
    ),
    Rule(
        "PERF-PY-001", "N+1 Query Pattern (Python)", "python", "medium", "performance", "",
        r"(?:\.execute|\.query|\.filter|\.get|session\.)\s*\(",
        "(?:bulk|batch|in_|prefetch|select_related|join)",
        "Database query inside a loop suggests N+1 query problem",
        "Use select_related/prefetch_related (Django) or eager loading (SQLAlchemy) to batch queries",
    ),
    Rule(
        "PERF-ANY-001", "Synchronous Sleep", "any", "low", "performance", "",
        r"(?:time\.Sleep|sleep\(|setTimeout.*\d{4,}|Thread\.sleep)",
        "(?i)(?:test|spec|mock|backoff|retry)",
        "Hardcoded sleep/delay found; consider exponential backoff or event-driven approach",
        "Use exponential backoff for retries or event-driven signaling instead of fixed sleeps",
    ),
    Rule(
        "SEC-ANY-001", "TODO Security", "any", "medium", "security", "",
        r"(?i)(?://|#|/\*)\s*(?:TODO|FIXME|HACK|XXX).*(?:security|auth|crypt|password|token|vuln|inject|xss|csrf)",
        None,
        "TODO/FIXME/HACK comment related to security found in code",
        "Address security-related TODOs before shipping; they indicate known unresolved issues",
    ),
    Rule(
        "SEC-ANY-002", "Private Key in Source", "any", "critical", "security", "CWE-798",
        r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----",
        "(?i)(?:test|example|sample|mock|fixture)",
        "Private key material appears to be embedded in source code",
        "Remove private keys from source; load them from secure storage or environment at runtime",
    ),
    Rule(
        "SEC-ANY-003", "HTTP in Production", "any", "low", "security", "CWE-319",
        "http://[a-zA-Z][a-zA-Z0-9._-]*",
        r"(?i)(?:http://localhost|http://127\.0\.0\.1|http://0\.0\.0\.0|http://\[?::1|http://example\.com|test|spec|mock|doc|xmlns|http://www\.w3\.org)",
        "Insecure HTTP URL used where HTTPS should be expected",
        "Use HTTPS for all production URLs to prevent man-in-the-middle attacks",
    ),
    Rule(
        "SEC-RS-001", "Unsafe Block", "rust", "high", "security", "CWE-242",
        r"\bunsafe\s*\{",
        None,
        "unsafe block bypasses Rust's memory safety guarantees; ensure the invariant is upheld",
        "Avoid unsafe blocks; use safe abstractions. If required, document the safety invariant in a comment",
    ),
    Rule(
        "SEC-RS-002", "unwrap() in Production", "rust", "medium", "correctness", "CWE-252",
        r"\.unwrap\(\)",
        r"(?i)(?:test|#\[test|#\[cfg\(test|expect\()",
        "unwrap() will panic at runtime if the value is None/Err; handle errors gracefully instead",
        "Use match, if let, or the ? operator to handle Option/Result properly",
    ),
    Rule(
        "SEC-RS-003", "Hardcoded Secret (Rust)", "rust", "critical", "security", "CWE-798",
        r'(?i)(?:password|secret|api_?key|token|private_?key)\s*(?:=>|:)\s*"[^"]{4,}',
        "(?i)(?:test|example|placeholder|TODO|CHANGE|xxx|dummy|fake)",
        "Hardcoded password or secret string detected",
        "Use environment variables or a secrets manager instead of hardcoded credentials",
    ),
    Rule(
        "SEC-RS-004", "SQL Injection (Rust)", "rust", "critical", "security", "CWE-89",
        r'format!\s*\(\s*"[^"]*(?:SELECT|INSERT|UPDATE|DELETE|DROP)[^"]*\{',
        None,
        "format! macro used in SQL query construction; use parameterized queries",
        "Use parameterized queries with $1 placeholders (e.g., sqlx or diesel) instead of format!",
    ),
    Rule(
        "SEC-RS-005", "Command Injection (Rust)", "rust", "critical", "security", "CWE-78",
        r"""Command::new\s*\([^"'][^)]*\)""",
        r'Command::new\s*\(\s*"[^"]+"\s*\)',
        "Command::new with user-controlled input may allow command injection",
        "Validate and sanitize all input passed to Command::new; use an allowlist of permitted commands",
    ),
    Rule(
        "SEC-C-001", "Buffer Overflow", "c", "critical", "security", "CWE-120",
        r"\b(?:strcpy|strcat|sprintf|gets)\s*\(",
        "(?:strncpy|strncat|snprintf|fgets|safe)",
        "Unsafe string function (strcpy, strcat, sprintf, gets) used without bounds checking",
        "Use bounded variants: strncpy, strncat, snprintf, or fgets instead",
    ),
    Rule(
        "SEC-C-002", "Format String Vulnerability", "c", "high", "security", "CWE-134",
        r"\b(?:printf|fprintf|sprintf|snprintf)\s*\(\s*[a-zA-Z_][a-zA-Z0-9_]*\s*[,)]",
        None,
        "printf-family function called with non-literal format string; may enable format string attacks",
        'Use a literal format string: printf("%s", var) instead of printf(var)',
    ),
    Rule(
        "SEC-C-003", "Use-After-Free Risk", "c", "high", "security", "CWE-416",
        r"\bfree\s*\(\s*\w+\s*\)",
        r"(?:(?:\w+)\s*=\s*NULL|=\s*0\b)",
        "Pointer used after free() call without being set to NULL",
        "Set pointer to NULL after free() to prevent use-after-free and double-free",
    ),
    Rule(
        "SEC-C-004", "Hardcoded Secret (C/C++)", "c", "critical", "security", "CWE-798",
        r'(?i)(?:password|secret|api_?key|token|private_?key)\s*=\s*"[^"]{4,}"',
        "(?i)(?:test|example|placeholder|TODO|CHANGE|xxx|dummy|fake)",
        "Hardcoded password or secret string detected",
        "Use environment variables or a secure configuration mechanism instead of hardcoded secrets",
    ),
    Rule(
        "SEC-C-005", "Command Injection (C)", "c", "critical", "security", "CWE-78",
        r"\b(?:system|popen)\s*\(\s*[a-zA-Z_]",
        r'\b(?:system|popen)\s*\(\s*"[^"]*"\s*\)',
        "system() or popen() with user-controlled input may allow command injection",
        "Use execve() with an explicit argument vector instead of system()/popen() with shell interpretation",
    ),
    Rule(
        "SEC-CPP-001", "Buffer Overflow (C++)", "cpp", "critical", "security", "CWE-120",
        r"\b(?:strcpy|strcat|sprintf|gets)\s*\(",
        "(?:strncpy|strncat|snprintf|fgets|std::string|safe)",
        "Unsafe string function (strcpy, strcat, sprintf, gets) used without bounds checking",
        "Use std::string or bounded variants: strncpy, strncat, snprintf, or fgets instead",
    ),
    Rule(
        "SEC-CPP-002", "Format String Vulnerability (C++)", "cpp", "high", "security", "CWE-134",
        r"\b(?:printf|fprintf|sprintf|snprintf)\s*\(\s*[a-zA-Z_][a-zA-Z0-9_]*\s*[,)]",
        None,
        "printf-family function called with non-literal format string",
        "Use a literal format string or std::cout / fmt::format instead",
    ),
    Rule(
        "SEC-CPP-003", "Use-After-Free Risk (C++)", "cpp", "high", "security", "CWE-416",
        r"\b(?:free\s*\(\s*\w+\s*\)|delete\s+\w+)",
        r"(?:(?:\w+)\s*=\s*(?:NULL|nullptr)|=\s*0\b|unique_ptr|shared_ptr)",
        "Pointer used after free()/delete without being set to nullptr",
        "Use smart pointers (unique_ptr, shared_ptr); set raw pointers to nullptr after delete",
    ),
    Rule(
        "SEC-CPP-004", "Hardcoded Secret (C++)", "cpp", "critical", "security", "CWE-798",
        r'(?i)(?:password|secret|api_?key|token|private_?key)\s*=\s*"[^"]{4,}"',
        "(?i)(?:test|example|placeholder|TODO|CHANGE|xxx|dummy|fake)",
        "Hardcoded password or secret string detected",
        "Use environment variables or a secure configuration mechanism instead of hardcoded secrets",
    ),
    Rule(
        "SEC-CPP-005", "Command Injection (C++)", "cpp", "critical", "security", "CWE-78",
        r"\b(?:system|popen)\s*\(\s*[a-zA-Z_]",
        r'\b(?:system|popen)\s*\(\s*"[^"]*"\s*\)',
        "system() or popen() with user-controlled input may allow command injection",
        "Use execve() or boost::process with an explicit argument vector instead of system()/popen()",
    ),
    Rule(
        "SEC-JV-001", "SQL Injection (Java)", "java", "critical", "security", "CWE-89",
        r"(?:(?:execute|executeQuery|executeUpdate)\s*\(.*\+)|(?:(?:Statement|createStatement).*\+)",
        "PreparedStatement|setParameter|bindValue",
        "String concatenation used in SQL statement execution; use PreparedStatement instead",
        "Use PreparedStatement with parameter placeholders (?) instead of string concatenation",
    ),
    Rule(
        "SEC-JV-002", "Insecure Deserialization (Java)", "java", "critical", "security", "CWE-502",
        r"ObjectInputStream.*\.readObject\s*\(",
        "(?i)(?:ValidatingObjectInputStream|ObjectInputFilter|whiteList|allowList)",
        "ObjectInputStream.readObject() can execute arbitrary code during deserialization",
        "Use ValidatingObjectInputStream or an ObjectInputFilter with a strict allowlist",
    ),
    Rule(
        "SEC-JV-003", "SSRF (Java)", "java", "high", "security", "CWE-918",
        r"new\s+URL\s*\(.*(?:req\.|request\.|param|input|query|user)",
        "(?i)(?:allowList|whitelist|validate.*url|UriUtils)",
        "new URL() with user-controlled input may lead to Server-Side Request Forgery",
        "Validate URLs against an allowlist of permitted domains and schemes",
    ),
    Rule(
        "SEC-JV-004", "Hardcoded Secret (Java)", "java", "critical", "security", "CWE-798",
        r'(?i)(?:password|secret|api_?key|token|private_?key)\s*=\s*"[^"]{4,}"',
        r"(?i)(?:test|example|placeholder|TODO|CHANGE|xxx|dummy|fake|System\.getenv)",
        "Hardcoded password or secret string detected",
        "Use environment variables, a secrets manager, or a vault instead of hardcoded credentials",
    ),
    Rule(
        "SEC-JV-005", "Path Traversal (Java)", "java", "high", "security", "CWE-22",
        r"new\s+File\s*\(.*(?:req\.|request\.|param|input|query|user|\+)",
        "(?i)(?:canonicalPath|normalize|sanitizePath|getCanonicalPath)",
        "new File() with user-controlled input may allow path traversal attacks",
        "Validate and normalize paths; ensure the resolved path is within the expected directory",
    ),
    Rule(
        "SEC-RB-001", "SQL Injection (Ruby)", "ruby", "critical", "security", "CWE-89",
        r"""(?:(?:\.where|\.find_by_sql|\.execute|\.query)\s*\(?\s*["'].*#\{)|(?:%[qQwWiI]?\{.*(?:SELECT|INSERT|UPDATE|DELETE).*#\{)""",
        None,
        "String interpolation in SQL query; use parameterized queries instead",
        "Use parameterized queries: Model.where('id = ?', id) or ActiveRecord::sanitize_sql",
    ),
    Rule(
        "SEC-RB-002", "Command Injection (Ruby)", "ruby", "critical", "security", "CWE-78",
        r"\b(?:system|exec|`)\s*[\(]?.*#\{",
        None,
        "system(), exec(), or backtick command with user-controlled input",
        "Use Open3.capture2 or Kernel#system with separate arguments to avoid shell injection",
    ),
    Rule(
        "SEC-RB-003", "Mass Assignment", "ruby", "high", "security", "CWE-915",
        r"\.permit!|params\s*\[|params\.require\(.*\)\.permit\s*[^(\w]",
        r"\.permit\s*\(\s*[:\w]",
        "permit! or unfiltered params usage allows arbitrary attribute assignment",
        "Use strong parameters: params.require(:model).permit(:field1, :field2) with explicit allowlist",
    ),
    Rule(
        "SEC-RB-004", "Hardcoded Secret (Ruby)", "ruby", "critical", "security", "CWE-798",
        r"""(?i)(?:password|secret|api_?key|token|private_?key)\s*=\s*['"][^'"]{4,}['"]""",
        r"(?i)(?:test|example|placeholder|TODO|CHANGE|xxx|dummy|fake|ENV\[)",
        "Hardcoded password or secret string detected",
        "Use ENV['VAR_NAME'], Rails credentials, or a secrets manager instead of hardcoded credentials",
    ),
    Rule(
        "SEC-RB-005", "ERB XSS", "ruby", "high", "security", "CWE-79",
        r"<%=\s*",
        r"(?i)(?:h\(|html_escape|sanitize|escape_javascript|CGI\.escape)",
        "<%= %> tag without sanitization may render user content unsafely",
        "Use <%=h ... %> or <%= sanitize(...) %> to escape user content in ERB templates",
    ),
    Rule(
        "SEC-SQL-001", "DROP TABLE in Migration", "sql", "high", "security", "",
        r"(?i)\bDROP\s+TABLE\b",
        r"(?i)(?:IF\s+EXISTS|migration|rollback|revert)",
        "DROP TABLE statement found; data loss is irreversible without backup",
        "Use 'DROP TABLE IF EXISTS' and ensure a rollback migration exists; consider soft deletes",
    ),
    Rule(
        "SEC-SQL-002", "Always-True Condition", "sql", "high", "security", "CWE-89",
        r"(?i)\b(?:OR\s+1\s*=\s*1|AND\s+1\s*=\s*1)\b",
        "(?i)(?:test|spec|mock)",
        "Tautological condition (1=1, OR 1=1) found; may indicate SQL injection or logic error",
        "Remove tautological conditions; if this is injection testing, use parameterized queries in production",
    ),
    Rule(
        "SEC-SQL-003", "UNION-Based Injection Pattern", "sql", "high", "security", "CWE-89",
        r"(?i)\bUNION\s+(?:ALL\s+)?SELECT\b",
        "(?i)(?:test|spec|mock|migration)",
        "UNION SELECT pattern may indicate SQL injection attack vector",
        "Use parameterized queries; never concatenate user input into SQL statements",
    ),
]
