"""The catalog of static security rules: a small table, one row per rule."""

from __future__ import annotations

from typing import NamedTuple

# Titles of the categories, and advice per weakness.
OWASP = {
    "A01": "A01:2021 Broken Access Control",
    "A02": "A02:2021 Cryptographic Failures",
    "A03": "A03:2021 Injection",
    "A05": "A05:2021 Security Misconfiguration",
    "A07": "A07:2021 Identification and Authentication Failures",
    "A08": "A08:2021 Software and Data Integrity Failures",
    "A09": "A09:2021 Security Logging and Monitoring Failures",
    "A10": "A10:2021 Server-Side Request Forgery",
}
FIXES = {
    "CWE-22": "Resolve the path and check that it stays below the allowed folder.",
    "CWE-78": "Pass arguments as a list, without a shell.",
    "CWE-79": "Escape the value for its place in the page.",
    "CWE-89": "Bind the value as a parameter of the statement.",
    "CWE-90": "Escape the value for the directory filter.",
    "CWE-94": "Render a fixed template and pass the value as data.",
    "CWE-95": "Replace the evaluation by a fixed set of operations.",
    "CWE-98": "Include only names from a fixed list.",
    "CWE-113": "Remove line breaks from the value.",
    "CWE-117": "Encode line breaks before logging.",
    "CWE-120": "Use the variant that takes the size of the buffer.",
    "CWE-134": "Use a literal format.",
    "CWE-209": "Send a general message and log the details.",
    "CWE-295": "Verify certificates.",
    "CWE-306": "Require authentication.",
    "CWE-321": "Keep the key outside of the source.",
    "CWE-327": "Use a current algorithm and mode.",
    "CWE-338": "Use a generator made for secrets.",
    "CWE-347": "Verify the signature with a fixed algorithm.",
    "CWE-352": "Keep the request-forgery protection.",
    "CWE-400": "Escape the value or bound the pattern.",
    "CWE-489": "Switch debugging off in production.",
    "CWE-502": "Use a data-only format.",
    "CWE-532": "Leave secrets out of the log.",
    "CWE-601": "Redirect only to known targets.",
    "CWE-611": "Disable external entities.",
    "CWE-613": "Set an expiry.",
    "CWE-614": "Set the secure flag.",
    "CWE-617": "Raise an error; assertions can be switched off.",
    "CWE-621": "Read the fields you need by name.",
    "CWE-643": "Bind the value as a variable of the expression.",
    "CWE-749": "Allow a fixed list of methods.",
    "CWE-798": "Read the value from the environment or a vault.",
    "CWE-915": "Allow a fixed list of fields.",
    "CWE-918": "Allow a fixed list of hosts.",
    "CWE-922": "Keep tokens in a cookie that scripts cannot read.",
    "CWE-942": "Name the allowed origins.",
    "CWE-943": "Check type and operators of the value.",
    "CWE-1004": "Set the HttpOnly flag.",
    "CWE-1022": "Add rel=noopener.",
    "CWE-1321": "Refuse the keys __proto__, constructor and prototype.",
}
_LANG = {"js": ("javascript", "typescript"), "py": ("python",), "cs": ("csharp",), "java": ("java",), "php": ("php",), "rb": ("ruby",), "go": ("go",), "c": ("c", "cpp")}

# pieces of expressions
_ARG = r"\s*\(\s*"
_NOLIT = r"(?![\"'`)])"
_JREQ = r"(?:req|request|ctx)\.(?:body|query|params|headers|cookies|url)"
_PREQ = r"request\.(?:args|form|GET|POST|values|json|data|params|query_params|get_json|cookies)"
_SUPER = r"\$_(?:GET|POST|REQUEST|COOKIE|SERVER|FILES)"
_CSREQ = r"Request(?:\.(?:Query|Form|Params|QueryString|Headers|Cookies|Path))?\b"
_JAVAREQ = r"(?:get(?:Parameter|Header|QueryString|Cookies)\s*\()"
_SECRET = r"(?:password|passwd|secret|token|api_?key|credential|private_?key)"


class Rule(NamedTuple):
    rule_id: str
    severity: str
    owasp: str
    cwe: str
    languages: str
    regex: str
    description: str
    noise: tuple[str, ...] = ()
    multiline: bool = False


def _r(*args, **more) -> Rule:
    return Rule(*args, **more)


# Ids, severities, categories and expressions, by which the same code gives the same findings.
RULES: tuple[Rule, ...] = (
    _r("js_sql_tpl_literal", "critical", "A03", "CWE-89", "js", r"\b(?:query|execute|run)\s*\(\s*`[^`]*\$\{", "Statement built by template"),
    _r("js_sql_concat", "critical", "A03", "CWE-89", "js", r"\b(?:query|execute|run)\s*\(\s*(?:\"[^\"\n]*\"|'[^'\n]*')\s*\+", "Statement built by concatenation"),
    _r("py_sql_fstring", "critical", "A03", "CWE-89", "py", r"\bexecute(?:many)?\s*\(\s*f[\"']", "Statement built by f-string"),
    _r("py_sql_format", "critical", "A03", "CWE-89", "py", r"\bexecute(?:many)?\s*\(\s*(?:\"[^\"\n]*(?:\"\s*\.format\s*\(|%[sd][^\"\n]*\")|'[^'\n]*(?:'\s*\.format\s*\(|%[sd][^'\n]*'))", "Statement built by formatting"),
    _r("py_sql_concat", "critical", "A03", "CWE-89", "py", r"\bexecute(?:many)?\s*\(\s*(?:\"[^\"\n]*\"|'[^'\n]*')\s*\+", "Statement built by concatenation"),
    _r("php_sql_input", "critical", "A03", "CWE-89", "php", rf"(?:\bmysqli?_query|->query)\s*\([^;)]*{_SUPER}", "Request value in a statement"),
    _r("java_sql_concat", "critical", "A03", "CWE-89", "java", r"\bexecute(?:Query|Update)?\s*\(\s*\"[^\"\n]*\"\s*\+", "Statement built by concatenation"),
    _r("go_sql_sprintf", "critical", "A03", "CWE-89", "go", r"\.(?:Query|Exec|QueryRow)(?:Context)?\s*\([^)\n]*fmt\.Sprintf", "Statement built by Sprintf"),
    _r("rb_sql_interp", "critical", "A03", "CWE-89", "rb", r"\b(?:execute|find_by_sql|where)\s*\(?\s*[\"'][^\"'\n]*#\{\s*(?:params|request)", "Request value in a statement"),
    _r("js_eval_dynamic", "high", "A03", "CWE-95", "js", rf"\beval{_ARG}{_NOLIT}", "Evaluation of a value"),
    _r("js_vm_runin", "high", "A03", "CWE-95", "js", r"\bvm\.runIn(?:New|This)?Context\s*\(", "Code run in a vm context"),
    _r("js_child_proc_dynamic", "high", "A03", "CWE-78", "js", rf"\b(?:exec|spawn)(?:Sync)?\s*\(\s*(?:[^)\n]*{_JREQ}|`[^`\n]*\$\{{)", "Command built from a value"),
    _r("py_eval_exec", "high", "A03", "CWE-95", "py", r"(?<![.\w])(?:eval|exec)\s*\(\s*(?![\"')])", "Evaluation of a value"),
    _r("py_subprocess_shell_true", "high", "A03", "CWE-78", "py", r"\bsubprocess\.\w+\s*\([^)]*shell\s*=\s*True", "Subprocess through a shell"),
    _r("py_os_system", "high", "A03", "CWE-78", "py", r"\bos\.(?:system|popen)\s*\(\s*(?![\"')])", "Shell command from a value"),
    _r("php_shell_exec_dynamic", "high", "A03", "CWE-78", "php", r"\b(?:shell_exec|exec|system|passthru|popen|proc_open)\s*\(\s*\$", "Shell command from a variable"),
    _r("php_eval_dynamic", "high", "A03", "CWE-95", "php", r"\beval\s*\(\s*\$", "Evaluation of a variable"),
    _r("rb_eval_dynamic", "high", "A03", "CWE-95", "rb", r"\b(?:eval|instance_eval|class_eval|module_eval)\s*\(\s*(?![\"')])", "Evaluation of a value"),
    _r("rb_system_interp", "high", "A03", "CWE-78", "rb", r"(?:`[^`\n]*#\{\s*(?:params|request)|\bsystem\s*\(?\s*\"[^\"\n]*#\{\s*(?:params|request))", "Request value in a command"),
    _r("c_dangerous_str_funcs", "high", "A03", "CWE-120", "c", r"\b(?:strcpy|strcat|gets|sprintf|vsprintf)\s*\(", "Copy without a bound"),
    _r("c_system_dynamic", "high", "A03", "CWE-78", "c", r"\bsystem\s*\(\s*(?![\")])", "Command from a value"),
    _r("c_printf_fmt_vuln", "critical", "A03", "CWE-134", "c", r"\b(?:printf\s*\(\s*|(?:fprintf|syslog)\s*\(\s*[^,()\n]+,\s*|snprintf\s*\(\s*[^,()\n]+,\s*[^,()\n]+,\s*)(?![\"\s)])", "Format is not a literal", ("_(", "gettext", "PRI", "FMT")),
    _r("go_exec_dynamic", "high", "A03", "CWE-78", "go", r"\bexec\.Command\s*\([^)\n]*(?:Sprintf|os\.Args|\+)", "Command built from a value"),
    _r("java_runtime_exec", "high", "A03", "CWE-78", "java", r"\bRuntime\.getRuntime\s*\(\s*\)\s*\.exec\s*\(", "Command through the runtime"),
    _r("js_nosql_where_tpl", "high", "A03", "CWE-943", "js", r"\$where[\"']?\s*:\s*`[^`]*\$\{", "Interpolated $where"),
    _r("js_nosql_input", "high", "A03", "CWE-943", "js", r"\.(?:find|findOne|update|updateOne|updateMany|delete|deleteOne|deleteMany|remove)\s*\(\s*\{?[^)\n]*\b(?:req|request)\.", "Request value in a query"),
    _r("py_ssti_render_string", "critical", "A03", "CWE-94", "py", r"\brender_template_string\s*\(\s*(?![\"')])", "Template from a value"),
    _r("js_innerhtml_dynamic", "high", "A03", "CWE-79", "js", r"\.innerHTML\s*\+?=(?!=)\s*(?![\"'`=\s])", "Markup from a value", ("DOMPurify", "sanitize", "escapeHtml", "escapeHTML", "encodeHTML", "textContent", "trustedHTML", "null")),
    _r("js_innerhtml_template", "medium", "A03", "CWE-79", "js", r"\.innerHTML\s*\+?=\s*`[^`\n]*\$\{[^`\n]*`", "Markup from a template", ("DOMPurify", "sanitize", "escapeHtml", "escapeHTML", "encodeHTML", "textContent", "trustedHTML", "encodeURIComponent")),
    _r("js_bypass_trust_html", "high", "A03", "CWE-79", "js", r"\bbypassSecurityTrust\w+\s*\(", "Sanitizer bypassed"),
    _r("php_echo_unsanitized", "high", "A03", "CWE-79", "php", rf"\b(?:echo|print)\s*\(?\s*{_SUPER}", "Request value in the page", ("htmlspecialchars", "htmlentities", "strip_tags", "intval")),
    _r("js_weak_hash", "medium", "A02", "CWE-327", "js", r"\bcreateHash\s*\(\s*[\"'](?:md5|sha1)[\"']", "Weak hash"),
    _r("py_weak_hash", "medium", "A02", "CWE-327", "py", r"\bhashlib\.(?:md5|sha1)\s*\(", "Weak hash"),
    _r("js_jwt_alg_none", "critical", "A02", "CWE-347", "js", r"\balgorithms?[\"']?\s*:\s*\[?\s*[\"']none[\"']", "Token without a signature"),
    _r("py_jwt_no_verify", "high", "A02", "CWE-347", "py", r"\bjwt\.decode\s*\([^)]*verify_signature[\"']?\s*[:=]\s*False", "Signature not verified"),
    _r("rb_jwt_alg_none", "critical", "A02", "CWE-347", "rb", r"\balgorithm[\"']?\s*(?:=>?|:)\s*[\"']none[\"']", "Token without a signature"),
    _r("any_hardcoded_secret", "medium", "A02", "CWE-798", "py js php rb go java", r"\b\w*(?:password|passwd|secret|api_?key|access_?key|auth_?token|private_?key)\w*[\"']?\s*[:=]\s*[\"'][A-Za-z0-9_\-+/=.!@#$%^&*]{8,}[\"']", "Value written into the source", ("example", "placeholder", "changeme", "your_", "YOUR_", "xxxx", "****", "<", "process.env", "os.environ", "getenv", "ENV[", "test", "dummy", "REPLACE", "vault")),
    _r("js_open_redirect", "high", "A01", "CWE-601", "js", r"\bres\.redirect\s*\(\s*(?:\d+\s*,\s*)?req\.", "Redirect to a request value"),
    _r("py_open_redirect", "high", "A01", "CWE-601", "py", r"\b(?:redirect|HttpResponseRedirect)\s*\(\s*request\.", "Redirect to a request value"),
    _r("js_path_traversal", "medium", "A01", "CWE-22", "js", rf"\bpath\.(?:join|resolve)\s*\([^)\n]*{_JREQ}", "Path from a request value"),
    _r("py_path_traversal", "medium", "A01", "CWE-22", "py", r"(?<![.\w])open\s*\(\s*request\.", "Path from a request value"),
    _r("php_file_inclusion", "high", "A01", "CWE-98", "php", rf"\b(?:include|require)(?:_once)?\s*\(?\s*{_SUPER}", "Included file from the request"),
    _r("php_extract_superglobal", "high", "A01", "CWE-621", "php", rf"\bextract\s*\(\s*{_SUPER}", "Variables from the request"),
    _r("rb_dynamic_send", "high", "A01", "CWE-749", "rb", r"\.(?:public_)?send\s*\(\s*params\[", "Method name from the request"),
    _r("py_pickle_load", "high", "A08", "CWE-502", "py", r"\b(?:c?[pP]ickle\.loads?|pickle\.Unpickler)\s*\(", "Unsafe deserialization"),
    _r("py_yaml_unsafe_load", "high", "A08", "CWE-502", "py", r"\byaml\.load\s*\(", "Unsafe deserialization", ("SafeLoader", "CSafeLoader", "safe_load", "BaseLoader")),
    _r("php_unserialize_input", "high", "A08", "CWE-502", "php", rf"\bunserialize\s*\(\s*{_SUPER}", "Unsafe deserialization"),
    _r("java_object_stream", "high", "A08", "CWE-502", "java", r"\bnew\s+ObjectInputStream\s*\(", "Unsafe deserialization"),
    _r("rb_yaml_load_unsafe", "high", "A08", "CWE-502", "rb", r"\bYAML\.load\s*\(", "Unsafe deserialization", ("safe_load", "permitted_classes", "safe:")),
    _r("js_ssrf_fetch", "high", "A10", "CWE-918", "js", r"\bfetch\s*\(\s*req\.", "Request to a given address"),
    _r("js_ssrf_axios", "high", "A10", "CWE-918", "js", r"\baxios(?:\.(?:get|post|put|delete|patch|head|request))?\s*\(\s*req\.", "Request to a given address"),
    _r("py_ssrf_requests", "high", "A10", "CWE-918", "py", r"\brequests\.(?:get|post|put|delete|patch|head|request)\s*\(\s*request\.", "Request to a given address"),
    _r("js_cors_wildcard", "medium", "A05", "CWE-942", "js", r"(?:Access-Control-Allow-Origin[\"']\s*[,:]\s*[\"']\*|\bcors\s*\(\s*\{[^}]*origin\s*:\s*[\"']\*)", "Any origin allowed"),
    _r("js_xxe_noent", "medium", "A05", "CWE-611", "js", r"\b(?:libxmljs|parseXml|parseXmlString|DOMParser|xml2js)\b[\s\S]{0,200}?noent\s*:\s*true", "External entities expanded"),
    _r("php_preg_replace_e", "high", "A05", "CWE-95", "php", r"\bpreg_replace\s*\(\s*[\"'](.)[^\"'\n]*\1[a-z]*e[a-z]*[\"']", "Replacement is evaluated"),
    _r("py_assert_auth", "medium", "A07", "CWE-617", "py", r"^[ \t]*assert\b[^\n]*\b(?:is_authenticated|is_admin|has_perm\w*|permission\w*|authori[sz]ed|current_user)\b", "Access check by assertion", ("self.assert", "pytest", "mock"), True),
    _r("cs_sql_concat", "critical", "A03", "CWE-89", "cs", r"\bnew\s+Sql(?:Command|DataAdapter)\s*\(\s*(?:\"[^\"\n]*\"\s*\+|\$@?\"[^\"\n]*\{|string\.Format)", "Statement built from values"),
    _r("cs_sql_interpolation", "critical", "A03", "CWE-89", "cs", r"(?:\bCommandText\s*=|\.Query(?:Async)?\s*(?:<[^>\n]*>)?\s*\()\s*\$@?\"[^\"\n]*\{", "Interpolated statement"),
    _r("cs_ef_raw_sql", "critical", "A03", "CWE-89", "cs", r"\.(?:FromSqlRaw|ExecuteSqlRaw(?:Async)?|ExecuteSqlCommand(?:Async)?|SqlQuery(?:Raw)?)\s*(?:<[^>\n]*>)?\s*\(\s*(?:\$@?\"|\"[^\"\n]*\"\s*\+|string\.Format)", "Raw statement from values"),
    _r("cs_process_start_dynamic", "high", "A03", "CWE-78", "cs", r"\bProcess\.Start\s*\(\s*(?![\"@)])", "Process from a value"),
    _r("cs_response_write_raw", "high", "A03", "CWE-79", "cs", r"\bResponse\.Write(?:Async)?\s*\(\s*(?![\"@)])", "Unescaped output", ("HtmlEncode", "AntiXss", "Encoder")),
    _r("cs_html_raw", "high", "A03", "CWE-79", "cs", r"\bHtml\.Raw\s*\(\s*(?![\"@)])", "Unescaped markup"),
    _r("cs_ldap_injection", "high", "A03", "CWE-90", "cs", r"\bDirectorySearcher\s*\([^)\n]*(?:\"\s*\+|\$\"[^\"\n]*\{)", "Directory filter from values"),
    _r("cs_weak_hash", "medium", "A02", "CWE-327", "cs", r"\b(?:MD5|SHA1|DES|TripleDES|RC2)(?:CryptoServiceProvider|Managed|\.Create)\b", "Weak algorithm"),
    _r("cs_ssl_validation_disabled", "high", "A02", "CWE-295", "cs", r"(?:ServerCertificate(?:Custom)?ValidationCallback\s*\+?=[^;\n]*(?:=>\s*true|return\s+true)|\bServicePointManager\.(?:ServerCertificateValidationCallback|CheckCertificateRevocationList\s*=\s*false))", "Certificates accepted unseen"),
    _r("cs_jwt_validation_disabled", "high", "A02", "CWE-347", "cs", r"\b(?:ValidateIssuer|ValidateAudience|ValidateLifetime|ValidateIssuerSigningKey|RequireSignedTokens)\s*=\s*false", "Token checks disabled"),
    _r("cs_binary_formatter", "critical", "A08", "CWE-502", "cs", r"\bBinaryFormatter\b", "Unsafe deserialization"),
    _r("cs_json_type_handling", "high", "A08", "CWE-502", "cs", r"\bTypeNameHandling\.(?:All|Objects|Arrays|Auto)\b", "Types taken from data"),
    _r("cs_object_state_formatter", "high", "A08", "CWE-502", "cs", r"\b(?:ObjectStateFormatter|LosFormatter|NetDataContractSerializer|SoapFormatter)\b", "Unsafe deserialization"),
    _r("cs_path_traversal", "medium", "A01", "CWE-22", "cs", rf"\b(?:File\.\w+|Path\.Combine|new\s+FileStream)\s*\([^)\n]*{_CSREQ}", "Path from a request value"),
    _r("cs_open_redirect", "high", "A01", "CWE-601", "cs", rf"\bRedirect(?:Permanent)?\s*\(\s*(?:{_CSREQ}|\w*[uU]rl\b)", "Redirect to a given address", ("IsLocalUrl", "LocalRedirect", "Url.Action", "RedirectToAction")),
    _r("cs_cors_allow_any", "medium", "A05", "CWE-942", "cs", r"\bAllowAnyOrigin\s*\(\s*\)", "Any origin allowed"),
    _r("cs_developer_exception_page", "low", "A05", "CWE-489", "cs", r"\bapp\.UseDeveloperExceptionPage\s*\(\s*\)", "Debug page", ("IsDevelopment", "env.", "if (")),
    _r("cs_allow_anonymous", "medium", "A07", "CWE-306", "cs", r"\[AllowAnonymous\]", "No authentication"),
    _r("cs_ignore_antiforgery", "medium", "A07", "CWE-352", "cs", r"\[IgnoreAntiforgeryToken\]", "No forgery protection"),
    _r("cs_ssrf_httpclient", "high", "A10", "CWE-918", "cs", rf"\.(?:Get|Post|Put|Delete|Send|GetString|GetStream)Async\s*\(\s*(?:{_CSREQ}|\w*[uU]r[li]\b)", "Request to a given address"),
    _r("java_weak_hash", "medium", "A02", "CWE-327", "java", r"\bMessageDigest\.getInstance\s*\(\s*\"(?:MD5|SHA-?1)\"", "Weak hash"),
    _r("java_ssl_trust_all", "high", "A02", "CWE-295", "java", r"\b(?:checkClientTrusted|checkServerTrusted|getAcceptedIssuers)\s*\([^)]*\)[^{;]*\{\s*(?:return\s+null\s*;\s*)?\}", "Certificates accepted unseen"),
    _r("java_xxe_enabled", "high", "A05", "CWE-611", "java", r"\.setFeature\s*\(\s*\"[^\"\n]*external-(?:general|parameter)-entities\"\s*,\s*true", "External entities enabled", ("false",)),
    _r("java_ssrf_urlopen", "high", "A10", "CWE-918", "java", rf"\bnew\s+URL\s*\([^;\n]*{_JAVAREQ}", "Request to a given address"),
    _r("java_open_redirect", "high", "A01", "CWE-601", "java", r"\bsendRedirect\s*\([^;\n]*getParameter\s*\(", "Redirect to a request value", ("validate", "encode")),
    _r("java_path_traversal", "medium", "A01", "CWE-22", "java", r"\bnew\s+File\s*\([^;\n]*getParameter\s*\(", "Path from a request value"),
    _r("go_weak_hash", "medium", "A02", "CWE-327", "go", r"\b(?:md5|sha1)\.New\s*\(", "Weak hash"),
    _r("go_ssrf_http_get", "high", "A10", "CWE-918", "go", r"\bhttp\.(?:Get|Post|Do|Head)\s*\([^)\n]*\br\.(?:URL|Form|FormValue|PostForm)", "Request to a given address"),
    _r("go_cors_wildcard", "medium", "A05", "CWE-942", "go", r"\bAllow(?:ed)?Origins\s*:\s*\[\]string\s*\{[^}]*\"\*\"", "Any origin allowed"),
    _r("js_math_random_token", "high", "A02", "CWE-338", "js", rf"\b\w*{_SECRET}\w*\s*(?::\s*\w+\s*)?=\s*[^;\n]*Math\.random\s*\(", "Secret from a weak generator"),
    _r("js_crypto_create_cipher", "medium", "A02", "CWE-327", "js", r"\bcrypto\.create(?:Cipher|Decipher)\s*\(", "Cipher without an initial value", ("createCipheriv",)),
    _r("go_tls_insecure_skip", "high", "A02", "CWE-295", "go", r"\bInsecureSkipVerify\s*:\s*true", "Certificates accepted unseen"),
    _r("java_ecb_mode", "high", "A02", "CWE-327", "java", r"\bCipher\.getInstance\s*\(\s*\"[^\"\n]*/ECB", "Weak cipher mode"),
    _r("cs_ecb_mode", "high", "A02", "CWE-327", "cs", r"\bMode\s*=\s*CipherMode\.ECB\b", "Weak cipher mode"),
    _r("js_function_constructor", "high", "A03", "CWE-95", "js", r"\bnew\s+Function\s*\(\s*(?!\))", "Code from a value"),
    _r("js_document_write_dyn", "high", "A03", "CWE-79", "js", r"\bdocument\.write(?:ln)?\s*\(\s*(?![\"'`)])", "Markup from a value"),
    _r("js_dangerously_set_html", "high", "A03", "CWE-79", "js", r"\bdangerouslySetInnerHTML\s*=", "Unescaped markup"),
    _r("js_proto_pollution_lodash", "high", "A03", "CWE-1321", "js", rf"\b(?:_|lodash)\.(?:merge|mergeWith|extend|assignIn|defaultsDeep|set)\s*\([^)\n]*{_JREQ}", "Merge of request data"),
    _r("js_proto_pollution_assign", "high", "A03", "CWE-1321", "js", r"\bObject\.assign\s*\([^)\n]*,\s*(?:\.\.\.)?req\.", "Merge of request data"),
    _r("js_nosql_regex_input", "medium", "A03", "CWE-943", "js", r"\$regex[\"']?\s*:\s*(?:new\s+RegExp\s*\(\s*)?(?:req|request)\.", "Pattern from a request value"),
    _r("py_format_star_kwargs", "high", "A03", "CWE-134", "py", r"\.format\s*\(\s*\*\*\s*request\.", "Format with request values"),
    _r("py_jinja2_no_autoescape", "high", "A03", "CWE-79", "py", r"\bEnvironment\s*\([^)]*autoescape\s*=\s*False", "Escaping disabled"),
    _r("go_template_html_cast", "high", "A03", "CWE-79", "go", r"\btemplate\.(?:HTML|HTMLAttr|CSS|JS|JSStr|URL|Attr)\s*\(", "Escaping bypassed"),
    _r("java_xpath_injection", "high", "A03", "CWE-643", "java", r"\.(?:compile|evaluate|selectNodes?)\s*\([^;\n]*getParameter\s*\(", "Expression from a request value"),
    _r("cs_xpath_injection", "high", "A03", "CWE-643", "cs", rf"\.(?:SelectNodes|SelectSingleNode|XPathSelectElements?|Compile|Evaluate)\s*\([^)\n]*{_CSREQ}", "Expression from a request value"),
    _r("java_log_user_input", "high", "A03", "CWE-117", "java", rf"\b(?:log|logger|LOG|LOGGER)\.(?:trace|debug|info|warn|error|fatal)\s*\([^;\n]*{_JAVAREQ}", "Request value in the log"),
    _r("py_flask_debug_true", "medium", "A05", "CWE-489", "py", r"(?:\bapp\.run\s*\([^)]*debug\s*=\s*True|\bapp\.debug\s*=\s*True)", "Debugging enabled"),
    _r("py_django_debug_true", "low", "A05", "CWE-489", "py", r"^DEBUG\s*=\s*True\b", "Debugging enabled", ("os.environ", "getenv", "env(", "config(", "if "), True),
    _r("js_error_stack_exposed", "medium", "A05", "CWE-209", "js", r"\bres\.(?:status\s*\(\s*\d+\s*\)\s*\.)?(?:send|json)\s*\([^)\n]*\b(?:err|error|e)\.stack\b", "Stack sent to the client"),
    _r("js_httponly_false", "medium", "A05", "CWE-1004", "js", r"\bhttpOnly\s*:\s*false", "Cookie readable by scripts"),
    _r("js_secure_false", "low", "A05", "CWE-614", "js", r"\b(?:cookie|session)\w*\s*[(:=][^;\n]*secure\s*:\s*false", "Cookie sent in the clear"),
    _r("cs_xml_dtd_parse", "high", "A05", "CWE-611", "cs", r"\bDtdProcessing\.Parse\b", "Document types processed"),
    _r("cs_xml_url_resolver", "high", "A05", "CWE-611", "cs", r"\bnew\s+XmlUrlResolver\b", "External entities resolved"),
    _r("php_xxe_libxml", "high", "A05", "CWE-611", "php", r"\blibxml_disable_entity_loader\s*\(\s*false", "External entities enabled"),
    _r("js_jwt_no_expiry", "medium", "A07", "CWE-613", "js", r"\bjwt\.sign\s*\(", "Token without an expiry", ("expiresIn", "exp:")),
    _r("js_localstorage_auth", "medium", "A07", "CWE-922", "js", r"\blocalStorage\.setItem\s*\(\s*[\"'`][^\"'`\n]*(?:token|jwt|auth|session)", "Token in local storage"),
    _r("rb_mass_assignment", "medium", "A01", "CWE-915", "rb", r"\.(?:create!?|update!?|build|new)\s*\(\s*params\b", "All request fields assigned", ("permit", "slice", "require(")),
    _r("js_nosql_full_req_query", "high", "A03", "CWE-943", "js", r"\.(?:find|findOne|findOneAndUpdate|count|aggregate|where|deleteMany|updateMany)\s*\(\s*req\.(?:body|query|params)\s*[,)]", "Whole request as a query"),
    _r("js_mass_assignment", "high", "A01", "CWE-915", "js", r"\.(?:create|bulkCreate|insert|insertOne|insertMany|save|build|upsert)\s*\(\s*req\.body\s*[,)]", "All request fields assigned"),
    _r("js_template_engine_user_input", "critical", "A03", "CWE-94", "js", rf"\b(?:ejs|pug|handlebars|Handlebars|nunjucks|mustache|Mustache|dot|swig)\.(?:render|compile|renderString|template)\w*\s*\([^)\n]*{_JREQ}", "Template from the request"),
    _r("js_outerhtml_dynamic", "high", "A03", "CWE-79", "js", r"\.outerHTML\s*\+?=(?!=)\s*(?![\"'`=\s])", "Markup from a value", ("DOMPurify", "sanitize", "escapeHtml", "escapeHTML", "encodeHTML", "textContent", "trustedHTML")),
    _r("js_insert_adjacent_html", "high", "A03", "CWE-79", "js", r"\.insertAdjacentHTML\s*\(\s*[^,()\n]+,\s*(?![\"'`\s])", "Markup from a value", ("DOMPurify", "sanitize", "escapeHtml", "escapeHTML", "encodeHTML", "textContent", "trustedHTML")),
    _r("js_jwt_verify_no_alg", "high", "A02", "CWE-347", "js", r"\bjwt\.verify\s*\(", "Algorithm not fixed", ("algorithms",)),
    _r("js_jwt_hardcoded_secret", "high", "A02", "CWE-798", "js", r"\bjwt\.(?:sign|verify)\s*\(\s*[^,()\n]+(?:\([^()\n]*\))?,\s*[\"'][^\"'\n]{8,}[\"']", "Signing key in the source"),
    _r("js_window_location_dynamic", "medium", "A01", "CWE-601", "js", r"\bwindow\.location(?:\.href)?\s*=(?!=)\s*(?![\"'`=\s])", "Navigation to a value", ("encodeURIComponent", "window.location.origin", "null", "sanitize")),
    _r("js_res_sendfile_user_path", "high", "A01", "CWE-22", "js", rf"\bres\.(?:sendFile|download)\s*\([^)\n]*{_JREQ}", "File from a request value", ("basename", "normalize", "root:", "sanitize")),
    _r("js_unserialize_call", "critical", "A08", "CWE-502", "js", r"\bunserialize\s*\(", "Unsafe deserialization"),
    _r("rb_render_inline_params", "critical", "A03", "CWE-94", "rb", r"\brender\s*\(?\s*:?inline\s*(?:=>|:)\s*params\[", "Template from the request"),
    _r("py_requests_verify_false", "high", "A02", "CWE-295", "py", r"\brequests\.\w+\s*\([^)]*verify\s*=\s*False", "Certificates accepted unseen"),
    _r("java_spring_csrf_disabled", "high", "A05", "CWE-352", "java", r"\.csrf\s*\(\s*\)\s*\.disable\s*\(\s*\)", "No forgery protection"),
    _r("py_django_csrf_exempt", "medium", "A05", "CWE-352", "py", r"@csrf_exempt\b", "No forgery protection"),
    _r("js_regex_user_input", "medium", "A03", "CWE-400", "js", r"\bnew\s+RegExp\s*\(\s*(?![\"'`/)\s])", "Pattern from a value", ("escapeRegExp", "escapeRegex")),
    _r("java_ldap_injection", "high", "A03", "CWE-90", "java", r"\b(?:ctx|context|dirContext|ldapTemplate)\.search\s*\([^;\n]*\"\s*\+", "Directory filter from values"),
    _r("php_header_injection", "high", "A03", "CWE-113", "php", rf"\bheader\s*\([^;\n]*{_SUPER}", "Header from the request"),
    _r("js_response_header_user_input", "high", "A03", "CWE-113", "js", rf"\bres\.(?:setHeader|header|set)\s*\([^)\n]*{_JREQ}", "Header from the request"),
    _r("py_logging_sensitive", "medium", "A09", "CWE-532", "py", rf"\b(?:log|logger|logging)\.(?:debug|info|warning|warn|error|critical|exception)\s*\([^)\n]*{_SECRET}", "Log line names a secret"),
    _r("js_logging_sensitive", "medium", "A09", "CWE-532", "js", rf"\b(?:console|logger|log)\.(?:log|debug|info|warn|error)\s*\([^)\n]*{_SECRET}", "Log line names a secret"),
    _r("js_open_tabnapping", "low", "A05", "CWE-1022", "js", r"[\"']_blank[\"']", "Window keeps its opener", ("noopener", "noreferrer")),
    _r("js_res_cookie_missing_httponly", "medium", "A05", "CWE-1004", "js", r"\bres\.cookie\s*\(", "Cookie readable by scripts", ("httpOnly", "HttpOnly", "clearCookie")),
    _r("js_zip_traversal", "high", "A01", "CWE-22", "js", r"\b(?:extract\w*|pipe|writeFile(?:Sync)?|createWriteStream)\s*\([^)\n]*\bentry\.(?:path|fileName|name|entryName)", "Archive entry names a path", ("basename", "normalize", "startsWith", "sanitize")),
    _r("py_debug_mode", "medium", "A05", "CWE-489", "py", r"(?:\bDEBUG\s*=\s*True\b|\bapp\.run\s*\([^)]*debug\s*=\s*True)", "Debugging enabled", ("os.environ", "getenv", "env(", "config(", "if ", "test")),
    _r("any_pem_private_key", "critical", "A02", "CWE-321", "js py php rb go java cs", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", "Private key in the source"),
    _r("js_tls_reject_unauthorized", "high", "A02", "CWE-295", "js", r"\brejectUnauthorized[\"']?\s*:\s*false", "Certificates accepted unseen"),
    _r("py_ssl_cert_none", "high", "A02", "CWE-295", "py", r"\bssl\.CERT_NONE\b", "Certificates accepted unseen"),
)


def register_rule(rule: Rule, rules: tuple[Rule, ...] | None = None) -> tuple[Rule, ...]:
    """The catalog with a rule added, or the one of its id replaced; without ``rules`` the catalog that scans use by default."""
    global RULES
    known = RULES if rules is None else rules
    out = tuple(r for r in known if r.rule_id != rule.rule_id) + (rule,)
    if rules is None:
        RULES = out
    return out


def languages(rule: Rule) -> list[str]:
    return [x for short in rule.languages.split() for x in _LANG[short]]


def rule_rows(rules: tuple[Rule, ...] | None = None) -> list[tuple]:
    """Rows of the rules table, one per rule and language: ``rule_id, severity, owasp, cwe, fix, description, language, regex, noise, ord``."""
    return [
        (r.rule_id, r.severity, OWASP.get(r.owasp, r.owasp), r.cwe, FIXES.get(r.cwe, ""), r.description, language, r.regex, list(r.noise), n)
        for n, r in enumerate(RULES if rules is None else rules)
        for language in languages(r)
    ]


RULE_SCHEMA = "rule_id string, severity string, owasp string, cwe string, fix string, description string, language string, regex string, noise array<string>, ord int"
