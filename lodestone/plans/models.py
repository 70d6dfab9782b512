"""Language models that are reached over HTTP, by the chat-completions interface that many servers speak."""

from __future__ import annotations

import json
import logging
import os
import time
import urllib.error
import urllib.request
from dataclasses import dataclass

from .. import errors

log = logging.getLogger("lodestone")
#: Used where neither the caller nor OPENAI_MODEL names one.
DEFAULT_MODEL = "gpt-4o"


@dataclass
class ChatModel:
    """A callable (system, prompt) -> text. It holds plain values only, so that it can go to the workers."""

    url: str
    key: str
    name: str
    timeout: float = 60.0

    def _once(self, system: str, prompt: str) -> str:
        body = {
            "model": self.name, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
        }
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as found:
                said = json.load(found)
        except urllib.error.HTTPError as e:
            known = e.code == 429 or e.code >= 500
            raise errors.ModelAPIError(
                f"the model answered {e.code}", context={"status_code": e.code}, recoverable=known
            ) from e
        except OSError as e:
            raise errors.ModelAPIError(f"the model can't be reached: {e}") from e
        try:
            return said["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise errors.ModelParseError("the model's answer has no message") from e

    def __call__(self, system: str, prompt: str) -> str:
        tries = 0
        while True:
            try:
                return self._once(system, prompt)
            except errors.ModelError as e:
                plan = errors.recovery(e)
                if not plan.can_retry or tries >= plan.max_retries:
                    raise
                wait = plan.backoff_ms[min(tries, len(plan.backoff_ms) - 1)] / 1000
                log.warning("%s; trying again in %.0f s", e, wait)
                time.sleep(wait)
                tries += 1


def openai(name: str | None = None, url: str | None = None) -> ChatModel:
    """A model by OPENAI_API_KEY, OPENAI_MODEL and, for another server with this interface, OPENAI_BASE_URL."""
    key = os.environ.get("OPENAI_API_KEY")
    if not key:
        raise errors.ConfigurationError("OPENAI_API_KEY isn't set", context={"key": "OPENAI_API_KEY"})
    return ChatModel(
        url or os.environ.get("OPENAI_BASE_URL", "https://api.openai.com/v1"),
        key,
        name or os.environ.get("OPENAI_MODEL", DEFAULT_MODEL),
    )


def llamacpp(url: str | None = None) -> ChatModel:
    """A model that a local llama.cpp server runs, at LLAMACPP_URL; the server knows the model's file."""
    url = url or os.environ.get("LLAMACPP_URL")
    if not url:
        raise errors.ConfigurationError("LLAMACPP_URL isn't set", context={"key": "LLAMACPP_URL"})
    return ChatModel(url, "none", os.environ.get("LLAMACPP_MODEL_NAME", "local"))
