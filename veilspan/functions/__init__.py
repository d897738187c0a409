"""Building blocks: patterns, checks, masks and text conversion.

The helpers take and return SQL expression text.  A rule set turns into large
expressions, and the parser builds those far faster than nested Column calls.
"""
