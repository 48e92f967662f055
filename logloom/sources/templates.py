"""Catalogue of text log templates: pattern, priority and how records continue over lines."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Template:
    """A named regular expression; its named groups are the columns, in order.

    continuation: "none", "indented" (lines that start with a blank) or "untilNextHeader" (lines that the pattern, or
    header_anchor if given, does not match at their start).
    """

    name: str
    pattern: str
    priority: int = 100
    continuation: str = "none"
    header_anchor: str | None = None
    samples: tuple[str, ...] = field(default=())
    auto_detect: bool = True

    @property
    def columns(self) -> list[str]:
        return re.findall(r"\(\?<([A-Za-z_]\w*)>", self.pattern)

    @property
    def java(self) -> str:
        """The pattern with plain groups, as Java allows no underscore in a group's name."""
        return re.sub(r"\(\?<([A-Za-z_]\w*)>", "(", self.pattern)

    @property
    def python(self) -> re.Pattern:
        return re.compile(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", self.pattern))

    def groups(self) -> list[tuple[str, int]]:
        """(column, number of its group in java)."""
        found, number = [], 0
        for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?!\?)|\(\?<([A-Za-z_]\w*)>", self.pattern):
            if m[0].startswith("("):
                number += 1
                if m[1]:
                    found.append((m[1], number))
        return found


#: Names, patterns, priorities and continuation modes of the built-in templates.
BUILT_IN = (
    Template(
        'Apache/nginx Combined Log Format',
        r"""^(?<clientip>\S+)\s+(?<ident>\S+)\s+(?<auth>\S+)\s+\[(?<timestamp>[^\]]+)\]\s+"(?:(?<verb>\S+)\s+(?<request>\S+)(?:\s+HTTP/(?<httpversion>\S+))?|-)"\s+(?<response>\d+)\s+(?<bytes>\d+|-)\s+"(?<referrer>[^"]*)"\s+"(?<agent>[^"]*)"$""",
        12,
    ),
    Template(
        'Apache/nginx Common Log Format',
        r"""^(?<clientip>\S+)\s+(?<ident>\S+)\s+(?<auth>\S+)\s+\[(?<timestamp>[^\]]+)\]\s+"(?:(?<verb>\S+)\s+(?<request>\S+)(?:\s+HTTP/(?<httpversion>\S+))?|-)"\s+(?<response>\d+)\s+(?<bytes>\d+|-)$""",
        15,
    ),
    Template(
        'Apache error log',
        r"""^\[(?<timestamp>[^\]]+)\]\s+\[(?<level>[^\]]+)\](?:\s+\[pid\s+(?<pid>\d+)(?::tid\s+\d+)?\])?(?:\s+\[client\s+(?<client>[^\]]+)\])?\s+(?<message>.*)$""",
        15,
        'indented',
    ),
    Template(
        'AWS Classic ELB access log',
        r"""^(?<timestamp>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z)\s+(?<elb>\S+)\s+(?<clientip>\S+):(?<clientport>\d+)\s+(?:(?<backendip>\S+):(?<backendport>\d+)|-)\s+(?<request_processing_time>-?\d+(?:\.\d+)?)\s+(?<backend_processing_time>-?\d+(?:\.\d+)?)\s+(?<response_processing_time>-?\d+(?:\.\d+)?)\s+(?<elb_status_code>-|\d{3})\s+(?<backend_status_code>-|\d{3})\s+(?<received_bytes>\d+)\s+(?<sent_bytes>\d+)\s+"(?:(?<verb>\S+)\s+(?<request>\S+)(?:\s+HTTP/(?<httpversion>\S+))?|-(?:\s+-){0,2}\s*)"\s+"(?<user_agent>[^"]*)"\s+(?<ssl_cipher>\S+)\s+(?<ssl_protocol>\S+)$""",
        10,
    ),
    Template(
        'AWS CloudFront access log',
        r"""^(?<date>\d{4}-\d{2}-\d{2})\t(?<time>\d{2}:\d{2}:\d{2})\t(?<edge_location>\S+)\t(?<bytes>\d+|-)\t(?<clientip>\S+)\t(?<verb>\S+)\t(?<host>\S+)\t(?<uri_stem>\S+)\t(?<status>\d{3}|-)\t(?<referrer>\S+)\t(?<agent>\S+)\t(?<query_string>\S+)\t(?<cookie>\S+)\t(?<edge_result_type>\S+)\t(?<edge_request_id>\S+)\t(?<host_header>\S+)\t(?<protocol>\S+)\t(?<bytes_received>\d+|-)\t(?<time_taken>\d+(?:\.\d+)?|-)\t(?<forwarded_for>\S+)\t(?<ssl_protocol>\S+)\t(?<ssl_cipher>\S+)\t(?<edge_response_result_type>\S+)\t(?<http_version>\S+)(?:\t.*)?$""",
        20,
    ),
    Template(
        'AWS S3 access log',
        r"""^(?<owner>\S+)\s+(?<bucket>\S+)\s+\[(?<timestamp>[^\]]+)\]\s+(?<clientip>\S+)\s+(?<requester>\S+)\s+(?<request_id>\S+)\s+(?<operation>\S+)\s+(?<key>\S+)\s+"(?:(?<verb>\S+)\s+(?<request>\S+)(?:\s+HTTP/(?<httpversion>\S+))?|-)"\s+(?<status>\d{3}|-)\s+(?<error_code>\S+)\s+(?<bytes_sent>\d+|-)\s+(?<object_size>\d+|-)\s+(?<total_time>\d+|-)\s+(?<turnaround_time>\d+|-)\s+"(?<referrer>[^"]*)"\s+"(?<agent>[^"]*)"\s+(?<version_id>\S+)(?:\s+(?<host_id>\S+)\s+(?<sig_version>\S+)\s+(?<cipher>\S+)\s+(?<auth_type>\S+)\s+(?<host_header>\S+)\s+(?<tls_version>\S+)(?:\s+(?<access_point_arn>\S+)(?:\s+(?<acl_required>\S+))?)?)?$""",
        10,
    ),
    Template(
        'BIND9 query log',
        r"""^(?<timestamp>\d{2}-[A-Z][a-z]{2}-\d{4}\s+\d{2}:\d{2}:\d{2}\.\d{3})\s+queries:\s+(?<level>info|debug|warning|error|notice):\s+client(?:\s+@0x[0-9a-fA-F]+)?\s+(?<clientip>[0-9a-fA-F:.]+)#(?<clientport>\d+)(?:\s+\((?<question>[^)]+)\))?:\s+query:\s+(?<query>\S+)\s+(?<class>\S+)\s+(?<qtype>\S+)\s+(?<flags>\S+)(?:\s+\((?<server>[^)]+)\))?$""",
        10,
    ),
    Template(
        'Cisco ASA syslog',
        r"""^(?:<(?<priority>\d{1,3})>)?(?:(?<timestamp>[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:\s+[A-Z]{3,4})?)\s+)?(?<hostname>[A-Za-z0-9][A-Za-z0-9._-]*)\s*:?\s*%ASA-(?<level>\d)-(?<message_id>\d+):\s+(?<message>.*)$""",
        10,
    ),
    Template(
        'Docker / containerd CRI runtime',
        r"""^(?<timestamp>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+\-]\d{2}:?\d{2}))\s+(?<stream>stdout|stderr)\s+(?<tag>[FP])\s+(?<message>.*)$""",
        10,
    ),
    Template(
        'Rust env_logger',
        r"""^\[(?<timestamp>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+\-]\d{2}:?\d{2})?)\s+(?<level>TRACE|DEBUG|INFO|WARN|ERROR)\s+(?<module>[\w:]+)\]\s+(?<message>.*)$""",
        20,
        'untilNextHeader',
    ),
    Template(
        'Exim mail log',
        r"""^(?<timestamp>\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\s+[+\-]\d{4})?)\s+(?:(?<pid>\[\d+\])\s+)?(?<message_id>[A-Za-z0-9]{6}-[A-Za-z0-9]{6}-[A-Za-z0-9]{2,4})?\s*(?<flag>(?:<=|=>|->|>>|\*\*|==|<>|Completed|SMTP connection from|SMTP connection outbound|no host name found for IP address|no IP address found for host|TLS error|Start queue run|End queue run|cancelled by timeout|temporarily refused connection|H=|U=|F=))?\s*(?<message>.*)$""",
        20,
    ),
    Template(
        'Generic bracketed level',
        r"""^\[(?<Level>\w+)\]\s+(?<Timestamp>\S+)\s+(?<Thread>\S+)\s+(?<Message>.*)$""",
        30,
        'indented',
    ),
    Template(
        'Google glog',
        r"""^(?<severity>[IWEF])(?<timestamp>\d{4}\s+\d{2}:\d{2}:\d{2}\.\d{6})\s+(?<thread>\d+)\s+(?<file>[^:]+):(?<line>\d+)\]\s+(?<message>.*)$""",
        10,
        'untilNextHeader',
    ),
    Template(
        'HAProxy HTTP',
        r"""^(?<timestamp>[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(?<hostname>\S+)\s+haproxy\[(?<pid>\d+)\]:\s+(?<clientip>\S+):(?<clientport>\d+)\s+\[(?<accept_date>[^\]]+)\]\s+(?<frontend_name>\S+)\s+(?<backend_name>\S+)/(?<server_name>\S+)\s+(?<tq>-?\d+)/(?<tw>-?\d+)/(?<tc>-?\d+)/(?<tr>-?\d+)/(?<tt>\+?\d+)\s+(?<status_code>\d{3})\s+(?<bytes_read>\d+)\s+(?<captured_request_cookie>\S+)\s+(?<captured_response_cookie>\S+)\s+(?<termination_state>\S+)\s+(?<actconn>\d+)/(?<feconn>\d+)/(?<beconn>\d+)/(?<srvconn>\d+)/(?<retries>\+?\d+)\s+(?<srv_queue>\d+)/(?<backend_queue>\d+)\s+\{(?<captured_request_headers>[^}]*)\}\s+\{(?<captured_response_headers>[^}]*)\}\s+"(?<verb>\S+)\s+(?<request>\S+)(?:\s+HTTP/(?<httpversion>\S+))?"$""",
        10,
    ),
    Template(
        'iptables / netfilter kernel log',
        r"""^(?:<(?<priority>\d{1,3})>)?(?<timestamp>[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(?<hostname>\S+)\s+kernel:\s+(?:\[\s*\d+\.\d+\]\s+)?(?:IPTABLES\s+)?(?<prefix>[^I]*?)IN=(?<input_iface>\S*)\s+OUT=(?<output_iface>\S*)(?:\s+MAC=(?<mac>\S+))?\s+SRC=(?<srcip>\S+)\s+DST=(?<dstip>\S+)\s+LEN=(?<length>\d+)(?:\s+TOS=\S+)?(?:\s+PREC=\S+)?\s+TTL=(?<ttl>\d+)\s+ID=(?<id>\d+)(?:\s+\S+)*?\s+PROTO=(?<protocol>\S+)(?:\s+SPT=(?<srcport>\d+))?(?:\s+DPT=(?<dstport>\d+))?(?:\s+.*)?$""",
        10,
    ),
    Template(
        'Java / log4j / SLF4J Logback',
        r"""^(?<timestamp>\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+\-]\d{2}:?\d{2})?)\s+(?<level>TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|SEVERE)\s+(?:\[(?<thread>[^\]]+)\]\s+)?(?:(?<logger>[\w$.]+(?:\$\w+)*)\s*[-:]\s+)?(?<message>.*)$""",
        20,
        'indented',
    ),
    Template(
        'MongoDB 3.x text log',
        r"""^(?<timestamp>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+\-]\d{2}:?\d{2}))\s+(?<severity>[FEWI]|D[1-5]?)\s+(?<component>[A-Z_-]+)\s+\[(?<context>[^\]]+)\]\s+(?<message>.*)$""",
        20,
        'indented',
    ),
    Template(
        'MySQL / MariaDB error log',
        r"""^(?<timestamp>\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+\-]\d{2}:?\d{2})?)\s+(?<thread>\d+)\s+\[(?<level>Note|Warning|ERROR|System|InnoDB)\](?:\s+\[(?<subsystem>[^\]]+)\])?\s+(?<message>.*)$""",
        10,
        'indented',
    ),
    Template(
        'Juniper NetScreen session log',
        r"""^(?:<(?<priority>\d{1,3})>)?(?<timestamp>[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(?<hostname>\S+):\s+NetScreen device_id=(?<device_id>\S+)\s+\[(?<facility>[^\]]+)\](?<level_tag>[^:]*):\s+start_time="(?<start_time>[^"]+)"\s+duration=(?<duration>\d+)\s+policy_id=(?<policy_id>\d+)\s+service=(?<service>\S+)\s+proto=(?<proto>\d+)\s+src\s*zone=(?<src_zone>\S+)\s+dst\s*zone=(?<dst_zone>\S+)\s+action=(?<action>\S+)\s+sent=(?<sent>\d+)\s+rcvd=(?<rcvd>\d+)\s+src=(?<srcip>\S+)\s+dst=(?<dstip>\S+)(?:\s+src_port=(?<srcport>\d+))?(?:\s+dst_port=(?<dstport>\d+))?(?:\s+src-xlated.*?)?(?:\s+session_id=(?<session_id>\d+))?(?:\s+reason=(?<reason>.*))?$""",
        10,
    ),
    Template(
        'nginx error log',
        r"""^(?<timestamp>\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+\[(?<level>debug|info|notice|warn|warning|error|crit|critical|alert|emerg|emergency)\]\s+(?<pid>\d+)#(?<tid>\d+):\s+(?:\*(?<cid>\d+)\s+)?(?<message>.*?)(?:,\s+client:\s+(?<clientip>[^,]+))?(?:,\s+server:\s+(?<server>[^,]*))?(?:,\s+request:\s+"(?<request>[^"]*)")?(?:,\s+upstream:\s+"(?<upstream>[^"]*)")?(?:,\s+host:\s+"(?<host>[^"]*)")?(?:,\s+referrer:\s+"(?<referrer>[^"]*)")?$""",
        10,
    ),
    Template(
        'PostgreSQL',
        r"""^(?<timestamp>\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:\s+[A-Z]{2,5})?)\s+\[(?<pid>\d+)\](?:\s+(?<user>\S+)@(?<database>\S+))?\s+(?<level>LOG|DEBUG[1-5]?|INFO|NOTICE|WARNING|ERROR|FATAL|PANIC|STATEMENT|DETAIL|HINT|CONTEXT|LOCATION):\s+(?<message>.*)$""",
        10,
        'indented',
    ),
    Template(
        'Ruby on Rails',
        r"""^(?<severity>[DIWEFU]),\s+\[(?<timestamp>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+)\s+#(?<pid>\d+)\]\s+(?<level>DEBUG|INFO|WARN|ERROR|FATAL|UNKNOWN)\s+--\s+(?<progname>[^:]*):\s+(?<message>.*)$""",
        10,
        'untilNextHeader',
    ),
    Template(
        'Redis',
        r"""^(?<pid>\d+):(?<role>[XCMSR])\s+(?<timestamp>\d{2}\s+[A-Z][a-z]{2}\s+\d{4}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+(?<level>[.\-*#])\s+(?<message>.*)$""",
        10,
    ),
    Template(
        'spdlog',
        r"""^\[(?<timestamp>\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3})\]\s+(?:\[(?<logger>[^\]]+)\]\s+)?\[(?<level>trace|debug|info|warning|warn|error|critical|off)\]\s+(?<message>.*)$""",
        20,
        'indented',
    ),
    Template(
        'Squid native access log',
        r"""^(?<timestamp>\d+\.\d+)\s+(?<duration>\d+)\s+(?<clientip>\S+)\s+(?<result>[A-Z_]+)/(?<status>\d{3})\s+(?<bytes>\d+)\s+(?<verb>\S+)\s+(?<url>\S+)\s+(?<rfc931>\S+)\s+(?<hierarchy>[A-Z_]+)/(?<server>\S+)\s+(?<mimetype>\S+)$""",
        10,
    ),
    Template(
        'Syslog (RFC3164)',
        r"""^(?<timestamp>[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+\-]\d{2}:?\d{2})?)\s+(?<hostname>\S+)\s+(?<program>[^\s\[:]+)(?:\[(?<pid>\d+)\])?:\s+(?<message>.*)$""",
        10,
    ),
    Template(
        'Syslog (RFC5424)',
        r"""^<(?<priority>\d+)>(?<version>\d+)\s+(?<timestamp>\S+)\s+(?<hostname>\S+)\s+(?<appname>\S+)\s+(?<procid>\S+)\s+(?<msgid>\S+)\s+(?<structured>\[(?:[^\]"]|"(?:\\.|[^"])*")*\]|-)\s*(?<message>.*)$""",
        10,
    ),
    Template(
        'Uber Zap (console)',
        r"""^(?<timestamp>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+\-]\d{2}:?\d{2}))\s+(?<level>DEBUG|INFO|WARN|ERROR|DPANIC|PANIC|FATAL)\s+(?:(?<caller>[^\s"]+:\d+)\s+)?(?<message>.*)$""",
        10,
        'untilNextHeader',
    ),
)


def catalogue(extra: tuple[Template, ...] = ()) -> list[Template]:
    """Built-ins by priority, then extras by priority; an extra of a built-in's name takes its place."""
    own = {t.name for t in extra}
    order = lambda t: t.priority
    return sorted((t for t in BUILT_IN if t.name not in own), key=order) + sorted(extra, key=order)


def faults(template: Template) -> list[str]:
    """Why a template cannot be used: it does not compile, has no named group, or misses one of its samples."""
    try:
        pattern = template.python
    except re.error as e:
        return [f"the pattern does not compile: {e}"]
    out = [] if template.columns else ["the pattern has no named group"]
    return out + [f"no match: {s}" for s in template.samples if not pattern.match(s)]
