"""The names, paths, addresses and keywords that the analyzers look for. What is done with them is in shell.py, sqltext.py, phrases.py and analyzers.py."""

from __future__ import annotations

# Shell: names of programs

SHELLS = frozenset("sh bash zsh dash ash ksh".split())
RUNNERS = SHELLS | frozenset("python python2 python3 pypy pypy2 pypy3 perl ruby node php".split())
CARRIERS = frozenset("sudo doas env nohup exec command time xargs".split())  # run what follows them
FETCHERS = frozenset("curl wget fetch".split())
NETWORK_TOOLS = FETCHERS | frozenset("nc ncat netcat socat ssh scp sftp ftp rsync ping nmap telnet dig nslookup".split())
WRITERS = frozenset("truncate mv cp rm mkdir touch".split())
REMOTE_GIT = frozenset("push pull fetch clone".split())
HOST_STOPPERS = frozenset("shutdown reboot poweroff halt".split())
DISK_TOOLS = frozenset("mkfs fdisk parted".split())
SYSTEM_PROCESSES = frozenset("systemd launchd init loginwindow".split())

#: Variables through which a program loads foreign code, by what they reach.
LINKER_VARIABLES = frozenset("LD_PRELOAD LD_LIBRARY_PATH DYLD_INSERT_LIBRARIES DYLD_LIBRARY_PATH DYLD_FRAMEWORK_PATH".split())
STARTUP_VARIABLES = frozenset("BASH_ENV ENV PERL5OPT RUBYOPT".split())
CODE_OPTIONS = ("--require", "--import", "--eval", "--inspect")

#: Targets whose loss is the loss of a system or a working tree.
ROOTS = ("/", "/*", "~", "~/", "$HOME", "$HOME/", ".", "./", "..", "../", "*", "./*", "/tmp/*", "/etc", "/etc/", "/usr", "/usr/")
NEAREST_ROOTS = ("/", "/*", "~", "~/", ".", "*", "/etc", "/etc/", "/usr", "/usr/")

#: Inline scripts: runtime -> its names, and the letter or long option before a script.
RUNTIMES = {
    "python": (frozenset("python python2 python3 pypy pypy2 pypy3".split()), "c", "--command"),
    "node": (frozenset(("node", "nodejs")), "e", "--eval"),
    "perl": (frozenset(("perl",)), "e", ""),
    "ruby": (frozenset(("ruby",)), "e", ""),
    "php": (frozenset(("php",)), "r", ""),
    "shell": (frozenset(("sh", "bash", "zsh")), "c", ""),
}
#: Functions that a script leaves its interpreter by when it calls them, by the last part of their name.
ESCAPE_CALLS = {
    "system": "system call of a shell",
    "popen": "pipe to a shell",
    "rmtree": "recursive delete",
    "rmSync": "file deletion",
    "rmdirSync": "file deletion",
    "unlinkSync": "file deletion",
    "rm": "file deletion",
    "execSync": "synchronous process",
    "spawnSync": "synchronous process",
    "shell_exec": "shell function",
    "passthru": "shell function",
}
#: Names that tell the same wherever they stand in a script; whole dotted names.
ESCAPE_NAMES = {
    "importlib": "dynamic import",
    "child_process": "child process module",
    "process.mainModule": "runtime internals",
    "process.binding": "runtime internals",
    "FileUtils.rm_rf": "FileUtils deletion",
    "FileUtils.rm": "FileUtils deletion",
    "FileUtils.remove_dir": "FileUtils deletion",
    "FileUtils.remove_entry": "FileUtils deletion",
    "Kernel.system": "Kernel shell call",
    "Kernel.exec": "Kernel shell call",
    "bytes.fromhex": "hex payload",
    "bytearray.fromhex": "hex payload",
    "unhexlify": "hex payload",
    "binascii.unhexlify": "hex payload",
    "subprocess.run": "subprocess call",
    "subprocess.Popen": "subprocess call",
    "subprocess.call": "subprocess call",
    "subprocess.check_output": "subprocess call",
}
HIDDEN_IMPORTS = frozenset(("os", "subprocess", "fs", "node:fs", "child_process", "node:child_process", "vm", "node:vm"))
OS_FUNCTIONS = frozenset(("system", "popen", "exec", "spawn", "*"))

#: Credentials: names of files and folders, a folder with what it holds, and system files.
SECRET_PARTS = frozenset(
    """.env id_rsa id_ed25519 id_ecdsa id_dsa id_rsa.pub id_ed25519.pub id_ecdsa.pub id_dsa.pub .ssh ssh .npmrc npmrc .netrc netrc .pgpass pgpass .my.cnf my.cnf
    .vault-token vault-token .oci oci .azure azure .terraform.d terraform.d""".split()
)
SECRET_PAIRS = frozenset(((a, b) for d, bs in (("aws", ("credentials", "config")), ("config", ("gcloud",)), ("kube", ("config",))) for a in (d, "." + d) for b in bs))
ETC_SECRETS = frozenset("shadow passwd master.passwd sudoers".split())

#: Addresses of cloud metadata services, in all spellings that are looked for.
METADATA_WORDS = ("169.254.169.254", "metadata.google.internal", "169.254.170.2", "2852039166", "2852039170", "0xa9fea9fe", "0xa9.0xfe.0xa9.0xfe", "0251.0376.0251.0376")
METADATA_HOSTS = METADATA_WORDS[:3]

# SQL

DROPPED = frozenset("DATABASE SCHEMA TABLE VIEW INDEX TRIGGER FUNCTION PROCEDURE".split())
CHANGES = frozenset("DROP DELETE TRUNCATE UPDATE INSERT GRANT ALTER".split())
STATEMENTS = {"SELECT": "SELECT", "INSERT": "INSERT", "UPDATE": "UPDATE", "DELETE": "DELETE", "CREATE": "DDL", "ALTER": "DDL", "DROP": "DDL", "TRUNCATE": "DDL"}
AFTER_CONDITION = frozenset("RETURNING ORDER LIMIT GROUP HAVING WINDOW INTO".split())
FILE_FUNCTIONS = frozenset("PG_READ_FILE PG_READ_BINARY_FILE PG_WRITE_FILE LO_IMPORT LO_EXPORT LO_GET LO_PUT LOAD_FILE".split())
REMOTE_FUNCTIONS = frozenset("OPENROWSET OPENDATASOURCE DBLINK".split())
ESCAPE_PACKAGES = frozenset("DBMS_SCHEDULER DBMS_JAVA UTL_FILE UTL_HTTP UTL_TCP UTL_SMTP".split())
LOB_LOADERS = frozenset("LOADFROMFILE LOADBLOBFROMFILE".split())
DYNAMIC = ("QUERY_TO_XML", "CURSOR_TO_XML", "DBLINK")  # and what begins so
BEFORE_TABLES = ("FROM", "JOIN", "INTO", "UPDATE", "TABLE")

# Paths

SECRET_NAMES = frozenset(
    ".env .env.local .env.production .env.development id_rsa id_ed25519 id_ecdsa id_dsa known_hosts authorized_keys credentials master.key "
    "service-account.json shadow passwd sudoers .npmrc .netrc .pgpass .my.cnf .vault-token .git-credentials .gitconfig".split()
)
SECRET_FOLDERS = ("/.ssh/", "/.aws/", "/.kube/", "/.docker/", "/.gnupg/", "/.oci/", "/.azure/", "/.terraform.d/")
SYSTEM_FILES = ("/etc/shadow", "/etc/passwd", "/etc/sudoers")

# Gates of the scan of calls that no route claims

SHELL_WORDS = frozenset("rm git cat chmod find curl wget python node sh bash sudo dd kill shred rsync ruby perl php ftp sftp scp nc ncat netcat socat".split())
SHELL_MARKS = frozenset("|;&>")
SQL_STARTS = frozenset("SELECT INSERT UPDATE DELETE DROP TRUNCATE ALTER CREATE GRANT COPY WITH DO ATTACH EXEC".split())
PATH_STARTS = ("/", "./", "../", ".\\", "..\\", "~", ".env")
PATH_PARTS = ("/.ssh/", "/.aws/", "/etc/passwd")
PATH_KEYS = ("path", "file")
URL_STARTS = ("http://", "https://", "//")
URL_KEYS = ("url", "endpoint", "host")
SQL_KEYS = ("sql", "query")
