"""Schemas of the meeting tables. Every derived column is declared and nullable; blank and null mean the same."""

SPEAKER = "struct<name:string,organization:string,stance:string,summary:string,source:string,said:array<string>,heard:boolean,time_start_ms:bigint>"
CHIP = "struct<category:string,text:string>"
ATTACHMENT = "struct<name:string,url:string>"
MEETINGS = "meeting_id string, title string, date string, start_time string, location string, has_video boolean, has_agenda boolean, is_cancelled boolean"
SEGMENTS = "meeting_id string, seq int, start_ms bigint, end_ms bigint, text string"
ITEMS = (
    "meeting_id string, pos int, item_id bigint, title string, content string, section_number string, time_start_ms bigint, time_end_ms bigint, "
    "recommendation string, motion_text string, vote_result string, vote_detail string, is_contested boolean, timestamp_inherited boolean, is_recess boolean, scheduled boolean, "
    f"attachments array<{ATTACHMENT}>, speakers array<{SPEAKER}>, description array<string>, chips array<{CHIP}>"
)
LISTING = (
    "d struct<TotalCount:int,Meetings:array<struct<Id:string,MeetingType:string,Start:string,FormattedStart:string,LocationName:string,"
    "HasVideo:boolean,HasAgenda:boolean,Cancelled:boolean,MeetingLinks:array<struct<Title:string>>>>>"
)
CALENDAR = "d array<struct<ID:string,MeetingType:string,StartDate:string,FormattedStart:string,Location:string,HasAgenda:boolean,MeetingPassed:boolean>>"
GIST = "struct<what:string,who:string,when:string,where:string,why:string>"
VERDICTS = "key string, faithfulness int, specificity int, non_redundancy int, quote string, claims array<string>"
