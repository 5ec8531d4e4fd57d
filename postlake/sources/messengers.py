"""Sinks that call out: a bot, a webhook and a local socket. Text is sent as plain text, without previews or mentions.

A sink is made where it is used, so what makes it (``maker``) travels to the tasks, not a connection.
"""

from __future__ import annotations

import json
import socket
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from .http import Failed, Retryable, Transport, call, urlopen
from .sinks import SINKS, Sink, Temporary

#: Fixed value: where bots are called if no other host is given.
BOT_HOST = "https://api.telegram.org"
#: Fixed value: the commands that a chat may give.
COMMANDS = ("/digest", "/status")
#: Bytes of a reply on the socket, and updates asked for at a time.
MOST_REPLY, UPDATES = 1_000_000, 100


def _tried(*args, **kwargs) -> dict:
    try:
        return call(*args, **kwargs)
    except Retryable as e:
        raise Temporary(str(e), e.after) from None


def _answers(check: Callable[[], dict]) -> bool:
    try:
        check()
    except (Failed, Temporary):
        return False
    return True


@dataclass
class Bot:
    """A chat bot: a message for each part, into one chat."""

    token: str = field(repr=False)
    chat: str
    host: str = ""
    timeout: float = 30.0
    transport: Transport = field(default=urlopen, repr=False)

    def __post_init__(self) -> None:
        if not self.token or not self.chat:
            raise ValueError("a bot needs a token and a chat")

    def _call(self, what: str, payload: dict) -> dict:
        found = _tried("telegram", "POST", f"{(self.host or BOT_HOST).rstrip('/')}/bot{self.token}/{what}", payload, timeout=self.timeout, transport=self.transport)
        if found.get("ok") is False:
            raise Failed(f"telegram: error {found.get('error_code')!r}")
        return found

    def send(self, key: str, part_no: int, text: str) -> None:
        if text:
            self._call("sendMessage", {"chat_id": self.chat, "text": text, "disable_web_page_preview": True})

    def healthy(self) -> bool:
        return _answers(lambda: self._call("getMe", {}))

    def updates(self, offset: int = 0) -> list[dict]:
        """What was written to the bot from ``offset`` on, as rows (update_id, chat_id, text); junk has nulls."""
        found = self._call("getUpdates", {"limit": UPDATES, "timeout": 0} | ({"offset": offset} if offset > 0 else {})).get("result")
        rows = []
        for update in found if isinstance(found, list) else ():
            if not isinstance(update, dict) or not isinstance(update.get("update_id"), int):
                continue
            message = update.get("message") if isinstance(update.get("message"), dict) else {}
            chat = message.get("chat") if isinstance(message.get("chat"), dict) else {}
            text = message.get("text") if isinstance(message.get("text"), str) else None
            rows.append({"update_id": update["update_id"], "chat_id": None if chat.get("id") is None else str(chat["id"]), "text": text})
        return rows


@dataclass
class Webhook:
    """A channel's webhook: a post for each part that mentions no one."""

    url: str = field(repr=False)
    timeout: float = 30.0
    transport: Transport = field(default=urlopen, repr=False)

    def __post_init__(self) -> None:
        if not self.url.startswith("https://"):
            raise ValueError("a webhook needs an https address")

    def send(self, key: str, part_no: int, text: str) -> None:
        if text:
            _tried("discord", "POST", self.url, {"content": text, "allowed_mentions": {"parse": []}}, timeout=self.timeout, transport=self.transport)

    def healthy(self) -> bool:
        return _answers(lambda: _tried("discord", "GET", self.url, timeout=self.timeout, transport=self.transport))


@dataclass
class Socket:
    """A daemon behind a local socket that takes a line of JSON-RPC and answers with one: notes to oneself."""

    path: str
    timeout: float = 30.0
    asked: int = 0

    def _call(self, method: str, params: dict) -> dict:
        self.asked += 1
        line = json.dumps({"jsonrpc": "2.0", "id": str(self.asked), "method": method, "params": params}) + "\n"
        got = bytearray()
        try:
            with socket.socket(socket.AF_UNIX) as s:
                s.settimeout(self.timeout)
                s.connect(self.path)
                s.sendall(line.encode())
                while b"\n" not in got and len(got) <= MOST_REPLY and (some := s.recv(1 << 16)):
                    got += some
        except OSError as e:
            raise Failed(f"signal: no connection ({type(e).__name__})") from None
        if len(got) > MOST_REPLY:
            raise Failed("signal: the reply is too large")
        try:
            reply = json.loads(bytes(got).partition(b"\n")[0].decode("utf-8", "replace"))
        except ValueError:
            raise Failed("signal: the reply is no JSON") from None
        if not isinstance(reply, dict):
            raise Failed("signal: the reply is no object")
        if isinstance(reply.get("error"), dict):
            raise Failed(f"signal: error {reply['error'].get('code')!r}")
        return reply["result"] if isinstance(reply.get("result"), dict) else {}

    def send(self, key: str, part_no: int, text: str) -> None:
        if text:
            self._call("send", {"noteToSelf": True, "message": text})

    def healthy(self) -> bool:
        return _answers(lambda: self._call("version", {}))


def maker(active: str, token: str = "", chat: str = "", url: str = "", path: str = "", host: str = "") -> Callable[[], Sink]:
    """What makes the sink of that name, checked here and now; unknown names are an error."""
    makers: dict[str, Callable[[], Sink]] = {"telegram": partial(Bot, token, chat, host), "discord": partial(Webhook, url), "signal": partial(Socket, path), **SINKS}
    if active not in makers:
        raise ValueError(f"no sink of the name {active!r}; there are {', '.join(sorted(makers))}")
    makers[active]()
    return makers[active]
