"""How producers spell what a reader must know: data, not code."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of the browser's trace format.
STIMULI = ("EventDispatch", "EventTiming")
FROM_A_PERSON = (
    "click", "auxclick", "dblclick", "mousedown", "mouseup", "pointerdown", "pointerup", "touchstart", "touchend",
    "keydown", "keyup", "keypress", "input", "change", "contextmenu", "wheel", "submit",
)
PRESENTATIONS = ("FramePresented", "firstContentfulPaint", "largestContentfulPaint")
ENVELOPES = ("EventTiming", "EventLatency")


@dataclass(frozen=True)
class Vocabulary:
    name: str
    stimuli: tuple[str, ...] = ()
    stimulus_kind: str = ""
    from_a_person: tuple[str, ...] = ()
    presentations: tuple[str, ...] = ()
    envelopes: tuple[str, ...] = ()
    #: identity, began, processing start, processing end, latency; milliseconds but for the first
    stated: tuple[str, ...] = ()


BY_NAME = {
    v.name: v
    for v in (
        Vocabulary("chrome", STIMULI, "type", FROM_A_PERSON, PRESENTATIONS, ENVELOPES, ("interactionId", "timeStamp", "processingStart", "processingEnd", "duration")),
        Vocabulary("unknown"),
    )
}
