"""trailmark.operators"""
