"""Transit facts: planned service, observed calls, departures and what follows from them."""
