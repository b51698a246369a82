"""A client for chat services over HTTP, with the standard library only. Instances are picklable and run on executors."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from base64 import b64encode
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np

from quire.operators.regions import png
from quire.operators.streams import deltas


class ServiceError(RuntimeError):
    pass


def address(base: str, path: str = "/chat/completions") -> str:
    """The driver's twin of functions.text.endpoint, with errors in place of null."""
    url = re.sub(r"/(chat/completions|completions|responses)$", "", (base or "").strip().rstrip("/"), flags=re.I)
    if not re.match(r"https?://", url, re.I):
        raise ServiceError(f"the service's address must begin with http:// or https://, not {url!r}" if url else "no address is set")
    return url + path


def explained(raw: str, url: str, status: int) -> str:
    head = raw[:200].strip()
    if re.match(r"<(!doctype|html)", head, re.I):
        return f"{url} returned a web page, not JSON: is it the service's address?"
    return head or f"{url} returned nothing (HTTP {status})"


@dataclass(frozen=True)
class ChatClient:
    base: str
    key: str
    model: str
    max_tokens: int = 8000
    temperature: float = 0.2
    timeout: float = 180.0

    def _open(self, path: str, body: dict | None):
        url = address(self.base, path)
        request = urllib.request.Request(url, json.dumps(body).encode() if body is not None else None, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            return urllib.request.urlopen(request, timeout=self.timeout)
        except urllib.error.HTTPError as e:
            raw = e.read().decode("utf-8", "replace")
            try:
                said = json.loads(raw)
                message = said.get("error", {}).get("message") or said.get("message") or explained(raw, url, e.code)
            except (ValueError, AttributeError):
                message = explained(raw, url, e.code)
            raise ServiceError(f"HTTP {e.code}: {message}") from e

    def _json(self, path: str, body: dict | None) -> dict:
        with self._open(path, body) as r:
            raw, status = r.read().decode("utf-8", "replace"), r.status
        try:
            return json.loads(raw)
        except ValueError as e:
            raise ServiceError(explained(raw, address(self.base, path), status)) from e

    def body(self, messages: list[dict], **more) -> dict:
        return {"model": self.model, "messages": messages, "max_tokens": self.max_tokens, "temperature": self.temperature, **more}

    def chat(self, messages: list[dict]) -> str:
        choices = self._json("/chat/completions", self.body(messages)).get("choices") or [{}]
        text = (choices[0].get("message") or {}).get("content") or ""
        if not text:
            raise ServiceError("the model's answer is empty")
        return text.strip()

    def __call__(self, system: str, user: str) -> str:
        return self.chat([{"role": "system", "content": system}, {"role": "user", "content": user}])

    def stream(self, messages: list[dict]) -> Iterator[str]:
        with self._open("/chat/completions", self.body(messages, stream=True)) as r:
            yield from deltas(x.decode("utf-8", "replace") for x in r)

    def models(self) -> list[str]:
        return sorted(m["id"] for m in self._json("/models", None).get("data", []))

    def probe(self) -> dict:
        """Whether the service answers: ok, the call's milliseconds, and the beginning of the reply or of the error."""
        began = time.monotonic()
        try:
            reply, ok = replace(self, max_tokens=500, timeout=40.0).chat([{"role": "user", "content": "Answer with one word: ready"}]), True
        except (ServiceError, OSError) as e:
            reply, ok = str(e), False
        return {"ok": ok, "ms": round(1000 * (time.monotonic() - began)), "reply": reply[:40]}

    def sees(self) -> bool:
        """Whether the model takes images: it is shown one of a single pixel."""
        try:
            replace(self, max_tokens=16, timeout=40.0).reader("ok?")(png(np.full((1, 1, 3), 255, np.uint8)))
            return True
        except (ServiceError, OSError):
            return False

    def reader(self, prompt: str, media: str = "image/png") -> Callable[[bytes], str]:
        """A function of an image's bytes to what the model reads in it."""
        return Reader(self, prompt, media)


@dataclass(frozen=True)
class Reader:
    client: ChatClient
    prompt: str
    media: str

    def __call__(self, image: bytes) -> str:
        url = f"data:{self.media};base64,{b64encode(image).decode()}"
        return self.client.chat([{"role": "user", "content": [{"type": "text", "text": self.prompt}, {"type": "image_url", "image_url": {"url": url}}]}])


def engine(choice: str, reader_is_set: bool) -> str:
    """Which engine reads pages: the one that is asked for, or by itself the model's if one is set."""
    return "model" if choice == "model" or (choice != "local" and reader_is_set) else "local"
