"""Explicit schemas of all documents and relations."""

from __future__ import annotations

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
VIDEO = "video_id string, fps double, tb_num int, tb_den int, w int, h int, n_frames int"
FRAME = "frame_idx int, pts bigint, time_sec double"
OBSERVATION = "shot_id bigint, frame_idx int, obs_ord bigint, x1 int, y1 int, x2 int, y2 int, confidence double, embedding array<float>, source string"
FACE = "struct<face_label:string,center_x:double,center_y:double,face_width:double,face_height:double>"
SHOTS_DOC = f"shots array<struct<shot_number:int,first_frame:int,last_frame:int,detected_faces:struct<face_count:int,face_details:array<{FACE}>>,detected_graphics:map<string,string>>>"
TRACK_OBS = "struct<frame_idx:int,bbox:array<int>,confidence:double,embedding:array<double>>"
TRACKS_DOC = f"tracks array<struct<shot_id:bigint,track_id:int,face_label:int,vchunk_id:int,observations:array<{TRACK_OBS}>>>"
FRAME_FACE = "struct<x:int,y:int,w:int,h:int,conf:double,source:string>"
FRAME_FACES = f"array<struct<frame:int,faces:array<{FRAME_FACE}>>>"
EMBEDDINGS = "map<string,map<string,map<string,array<float>>>>"
