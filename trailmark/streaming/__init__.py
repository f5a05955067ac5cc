"""trailmark.streaming"""
