"""Tables, streams and record envelopes."""
